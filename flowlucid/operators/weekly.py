"""Weekly label counts, weekly record bounds and the wide metric sheet.

All three come from one aggregate per (label, week), whose size is bounded by the
number of labels times the number of weeks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import label_text, week_start


def weekly_counts(df: DataFrame, label: str, ts: str = "ts") -> DataFrame:
    return (
        df.groupBy(label_text(label).alias("label"), week_start(ts).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _weekly_cube(df: DataFrame, label: str, ts: str) -> DataFrame:
    return (
        df.groupBy(label_text(label).alias("label"), week_start(ts).alias("week"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(ts).cast("timestamp_ntz").alias("first"),
            F.max(ts).cast("timestamp_ntz").alias("last"),
        )
    )


def _bounds(cube: DataFrame) -> DataFrame:
    """Per week: first, last, total, and the week's ends at the first record's time of day."""
    per_week = cube.groupBy("week").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("total"),
    )
    # One row per week is left here, so the unpartitioned window is small.
    earliest = F.min("first").over(Window.partitionBy())
    time_of_day = earliest - F.date_trunc("day", earliest).cast("timestamp_ntz")
    midnight = F.col("week").cast("timestamp_ntz")
    start = midnight + time_of_day
    return per_week.select(
        F.col("week").alias("week_start"), "first", "last",
        start.alias("dt_week_start"),
        (start + F.expr("interval 7 days")).alias("dt_week_end"),
        "total",
    )


def weekly_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    return _bounds(_weekly_cube(df.select(F.lit("all").alias("label"), F.col(ts)), "label", ts))


def _stamp(col: str) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def weekly_sheet(df: DataFrame, label: str, ts: str = "ts") -> DataFrame:
    """One row per label plus five statistics rows, one column per week with data.

    Rows are sorted by name; a cell without rows is null (empty in CSV).
    """
    # The column names need the list of weeks. The aggregate has a line per label and week and
    # comes to the driver once, so that nothing stays cached.
    cube = _weekly_cube(df, label, ts)
    lines = cube.collect()
    weeks = sorted({row.week for row in lines})
    cube = df.sparkSession.createDataFrame(lines, cube.schema)
    title = F.concat_ws(" - ", F.col("week").cast("string"), F.date_add("week", 7).cast("string"))
    counts = cube.select(F.col("label").alias("name"), "week", F.col("n").cast("string").alias("cell"))
    stats = _bounds(cube).select(
        F.col("week_start").alias("week"),
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("name"), cell.alias("cell"))
            for name, cell in {
                "dt_first_record": _stamp("first"),
                "dt_last_record": _stamp("last"),
                "dt_week_end": _stamp("dt_week_end"),
                "dt_week_start": _stamp("dt_week_start"),
                "total_record_count": F.col("total").cast("string"),
            }.items()
        ])),
    )
    titles = [f"{w} - {w.fromordinal(w.toordinal() + 7)}" for w in weeks]
    return (
        counts.unionByName(stats)
        .withColumn("title", title)
        .groupBy(F.col("name").alias(label)).pivot("title", titles).agg(F.first("cell"))
        .orderBy(label)
    )


def sheet_to_long(sheet: DataFrame) -> DataFrame:
    """The wide sheet as (name, week, cell) rows, without the empty cells."""
    name, *weeks = sheet.columns
    return (
        sheet.unpivot([name], weeks, "week", "cell")
        .filter(F.col("cell").isNotNull())
        .withColumnRenamed(name, "name")
    )
