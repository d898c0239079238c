"""Canonical flow table: column roles, types and fixed label values."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "uid"

# The columns and label spellings of the input data.
COUNT_COLUMNS = ["orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes"]
CATEGORICAL = ["proto", "service", "conn_state"]
LABELS = ["label_binary", "label_tactic", "label_technique"]
NUMERIC = [
    "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "duration",
    "pktAtsec", "BitRate", "interTime", "avgLenPkt",
]
MODEL_COLUMNS = [
    "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "duration",
    "proto", "service", "conn_state", "history",
    "label_binary", "label_tactic", "label_technique",
]
ATTACK_VALUES = ["True", "Duplicate"]
BENIGN_VALUES = ["False"]
MISSING_LABEL = "None"
JOINT_SEPARATOR = " - "

FLOW_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.LongType()) for c in COUNT_COLUMNS]
    + [T.StructField("duration", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in [*CATEGORICAL, "history", *LABELS]]
)

# A class or category list longer than this is no longer a label or a category:
# lists up to this length may be broadcast or kept on the driver.
MAX_CLASSES = 10_000
