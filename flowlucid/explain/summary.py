"""Summaries of attribution tables (uid, class, values array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def long_form(attributions: DataFrame, names: Sequence[str], keep: Sequence[str] = (KEY, "class")) -> DataFrame:
    """One row per (row, class, feature)."""
    labels = F.array(*[F.lit(n) for n in names])
    return attributions.select(*keep, F.inline(F.arrays_zip(labels.alias("feature"), F.col("values").alias("value"))))


def shap_points(attributions: DataFrame, rows: DataFrame, names: Sequence[str], key: str = KEY) -> DataFrame:
    """(row, class, feature, value, feature_value): each attribution beside the encoded value it
    explains, the data behind point plots. ``rows`` has the key once and ``features``."""
    labels = F.array(*[F.lit(n) for n in names])
    known = rows.select(key, vector_to_array("features").alias("x"))
    return attributions.join(known, key).select(key, "class", F.inline(F.arrays_zip(
        labels.alias("feature"), F.col("values").alias("value"), F.col("x").alias("feature_value"),
    )))


def shap_summary(
    attributions: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = ("class",),
) -> DataFrame:
    """Mean |value| per feature and group.

    Array input is aggregated slot by slot, so rows are not multiplied by the number of
    features; long input (feature, value) is grouped directly.
    """
    if names is None:
        return attributions.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    slots = [
        F.struct(F.lit(n).alias("feature"), F.avg(F.abs(F.get("values", F.lit(i)))).alias("mean_abs"))
        for i, n in enumerate(names)
    ]
    return attributions.groupBy(*by).agg(F.array(*slots).alias("s")).select(*by, F.inline("s"))


def only_supported(summary: DataFrame, support: DataFrame, cls: str = "class") -> DataFrame:
    """Keeps the classes with test rows. ``support`` has (class, n_test): one row per class."""
    return summary.join(support.filter("n_test > 0").select(cls), cls, "left_semi")
