"""Column expressions: rates, sizes, labels, weeks and hash order.

All of them are built-in expressions, so they stay inside whole-stage codegen
and do not hinder column pruning or predicate pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ATTACK_VALUES, BENIGN_VALUES, JOINT_SEPARATOR, MISSING_LABEL


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    """NaN counts as missing, like null."""
    return F.nanvl(_col(x).cast("double"), F.lit(None).cast("double"))


def safe_div(x: Column | str, y: Column | str) -> Column:
    """``x / y`` where a zero denominator counts as one and a missing one stays missing."""
    x, y = _col(x), _col(y)
    return x / F.when(y == 0, F.lit(1)).otherwise(y)


def derived_features() -> dict[str, Column]:
    """Rates and sizes of one flow, computed before any imputation."""
    duration = nan_to_null("duration")
    total_bytes = F.col("orig_bytes") + F.col("resp_bytes")
    return {
        "pktAtsec": safe_div("orig_pkts", duration),
        "BitRate": safe_div(total_bytes * 8, duration),
        "interTime": safe_div(duration, "orig_pkts"),
        "avgLenPkt": safe_div("orig_bytes", "orig_pkts"),
        "numPKT": F.col("orig_pkts") + F.col("resp_pkts"),
        "numBytes": total_bytes,
    }


def with_flow_features(df: DataFrame) -> DataFrame:
    return df.withColumns({**derived_features(), "duration": nan_to_null("duration")})


def encode_binary(df: DataFrame, name: str = "label_binary", strict: bool = True) -> Column:
    """1 for attack, 0 for benign. Booleans and numbers (also as text) pass through.

    An unknown or missing label raises when the row is read, or is null if not strict.
    """
    dtype = df.schema[name].dataType
    label = F.col(name)
    if isinstance(dtype, T.StringType):
        code = (
            F.when(label.isin(ATTACK_VALUES), 1)
            .when(label.isin(BENIGN_VALUES), 0)
            .otherwise(label.try_cast("int"))
        )
    else:
        code = label.cast("int")
    if strict:
        text = F.coalesce(label.cast("string"), F.lit("null"))
        message = F.concat(F.lit(f"{name}: no binary value for "), text)
        code = F.coalesce(code, F.raise_error(message).cast("int"))
    return code


def label_text(col: Column | str) -> Column:
    """A missing class label is a class of its own."""
    return F.coalesce(_col(col).cast("string"), F.lit(MISSING_LABEL))


def joint_label(tactic: Column | str = "label_tactic", technique: Column | str = "label_technique") -> Column:
    return F.concat(_col(tactic), F.lit(JOINT_SEPARATOR), _col(technique))


def with_joint_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label_joint", joint_label())


def tactic_of(joint: Column | str) -> Column:
    return F.split_part(_col(joint), F.lit(JOINT_SEPARATOR), F.lit(1))


def week_start(ts: Column | str) -> Column:
    """The Sunday on or before the record's date; the time of day plays no part."""
    ts = _col(ts)
    return F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)


def hash_key(key: Column | str, seed: int) -> Column:
    """Reproducible shuffle order: independent of partitioning and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
