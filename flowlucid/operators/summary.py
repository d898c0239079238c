"""Projections, filters and simple summaries of the flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import label_text
from ..schema import KEY, MAX_CLASSES, MODEL_COLUMNS


def select_model_columns(df: DataFrame, keep: Sequence[str] = (KEY,)) -> DataFrame:
    """The columns the models use, for every row, plus the row key."""
    return df.select(*keep, *MODEL_COLUMNS)


def filter_tactics(df: DataFrame, tactics: Sequence[str], label: str = "label_tactic") -> DataFrame:
    return df.filter(F.col(label).isin(list(tactics)))


def first_n(df: DataFrame, n: int, order: str = KEY) -> DataFrame:
    """The n rows with the smallest key (planned as a top-k, not a sort)."""
    return df.orderBy(order).limit(n)


def nth_row(df: DataFrame, k: int, order: str = KEY) -> DataFrame:
    """The row at 0-based position k in key order."""
    return df.orderBy(order).offset(k).limit(1)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def label_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def classes_of(df: DataFrame, col: str) -> list[str]:
    """The sorted class list of a label column; refuses a column that is no label."""
    found = df.select(label_text(col).alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{col} has more than {MAX_CLASSES} distinct values")
    # UTF-8 byte order is code-point order, in Spark as in Python.
    return sorted(row.c for row in found)


def index_of(col: Column | str, classes: Sequence[str]) -> Column:
    """Position of the label in the class list: a narrow expression, no join."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label_text(col))
    return F.when(position > 0, (position - 1).cast("int"))


def label_at(index: Column | str, classes: Sequence[str]) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def label_index(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row's label among the sorted labels."""
    return df.withColumn(name or f"{col}_idx", index_of(col, classes_of(df, col)))


def class_support(df: DataFrame, label: str, classes: Sequence[str], side: str = "is_test") -> DataFrame:
    """Rows per class in the train and the test part, with 0 where a class is absent.

    The zero rows are added after the counts, so no join is needed.
    """
    spark = df.sparkSession
    counted = df.groupBy(label_text(label).alias("class")).agg(
        F.count_if(~F.col(side)).alias("n_train"), F.count_if(F.col(side)).alias("n_test"),
    )
    zeros = (
        spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
        .select("class", F.lit(0).cast("bigint").alias("n_train"), F.lit(0).cast("bigint").alias("n_test"))
    )
    return counted.unionByName(zeros).groupBy("class").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"),
    )


def class_profile(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each feature within each class (long form)."""
    stats = [
        F.struct(
            F.lit(f).alias("feature"),
            F.avg(f).alias("mean"),
            F.stddev_pop(f).alias("std"),
            F.count(f).alias("n"),
        )
        for f in features
    ]
    return (
        df.groupBy(label).agg(F.array(*stats).alias("s"))
        .select(label, F.inline("s"))
    )
