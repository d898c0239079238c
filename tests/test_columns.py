import math

import pytest
from pyspark.sql import functions as F

from flowlucid.functions import (
    encode_binary, joint_label, label_text, nan_to_null, safe_div, tactic_of, week_start, with_flow_features,
)


def test_safe_div_zero_and_missing(spark):
    rows = spark.createDataFrame([(3, 0), (3, None), (3, 2), (None, 2)], "x long, y long")
    assert [r[0] for r in rows.select(safe_div("x", "y")).collect()] == [3.0, None, 1.5, None]


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([(math.nan,), (None,), (2.0,)], "x double")
    assert [r[0] for r in rows.select(nan_to_null("x")).collect()] == [None, None, 2.0]


def test_features_of_edge_rows(spark):
    rows = spark.createDataFrame(
        [(0, 1, 10, 20, 0.0), (4, 1, 10, None, math.nan), (4, 2, 10, 6, 2.0)],
        "orig_pkts long, resp_pkts long, orig_bytes long, resp_bytes long, duration double",
    )
    zero, missing, plain = with_flow_features(rows).collect()
    assert (zero.pktAtsec, zero.BitRate, zero.interTime, zero.avgLenPkt) == (0.0, 240.0, 0.0, 10.0)
    assert (missing.pktAtsec, missing.BitRate, missing.interTime, missing.numBytes) == (None, None, None, None)
    assert missing.duration is None and missing.avgLenPkt == 2.5
    assert (plain.pktAtsec, plain.BitRate, plain.interTime, plain.numPKT, plain.numBytes) == (2.0, 64.0, 0.5, 6, 16)


def test_binary_label_values(spark):
    rows = spark.createDataFrame([("True",), ("False",), ("Duplicate",), ("1",)], "label_binary string")
    assert [r[0] for r in rows.select(encode_binary(rows)).collect()] == [1, 0, 1, 1]
    for values, dtype in (([True, False], "boolean"), ([1, 0], "int"), ([1.0, 0.0], "double")):
        rows = spark.createDataFrame([(v,) for v in values], f"label_binary {dtype}")
        assert [r[0] for r in rows.select(encode_binary(rows)).collect()] == [1, 0]


@pytest.mark.parametrize("value", ["maybe", None])
def test_unknown_binary_label_raises_unless_lenient(spark, value):
    rows = spark.createDataFrame([(value,)], "label_binary string")
    with pytest.raises(Exception, match="no binary value"):
        rows.select(encode_binary(rows)).collect()
    assert rows.select(encode_binary(rows, strict=False)).first()[0] is None


def test_joint_label_and_roll_up(spark):
    rows = spark.createDataFrame([("A", "T1"), (None, "T1")], "label_tactic string, label_technique string")
    joint = rows.select(joint_label().alias("j"), label_text("label_tactic").alias("t")).collect()
    assert [(r.j, r.t) for r in joint] == [("A - T1", "A"), (None, "None")]
    assert rows.limit(1).select(tactic_of(joint_label())).first()[0] == "A"


def test_weeks_start_on_sunday_by_date(spark):
    rows = spark.createDataFrame(
        [("2021-12-17 13:00:45.251239",), ("2021-12-19 00:00:08.630389",), ("2021-12-18 23:59:59",)], "t string",
    )
    weeks = rows.select(week_start(F.col("t").cast("timestamp_ntz")).cast("string")).collect()
    assert [w[0] for w in weeks] == ["2021-12-12", "2021-12-19", "2021-12-12"]
