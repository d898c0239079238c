"""Reproducible splits and samples by hash order, exact at any class size.

"The first q rows of each class in hash order" needs no sort of a class: only the
hash of the q-th row. That cut is found by counting rows per hash prefix and looking
closer into the one prefix that holds the q-th row, until few enough rows are left to
rank. Each pass is one aggregate over (class, key); no class is ever gathered in one
task. With the cuts known, the selection is a narrow comparison on each row.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import small_table
from ..functions import hash_key, label_text, nan_to_null
from ..schema import KEY, MAX_CLASSES

# Up to this many rows of one class are ranked in one task.
RANK_LIMIT = 200_000
# Hex digits added to the prefix per pass: at most 65,536 counts per class.
PREFIX_DIGITS = 4


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    rows = df.groupBy(label_text(label).alias("c")).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values")
    return {r["c"]: r["count"] for r in rows}


def attach_by_class(df: DataFrame, label: str, values: dict, name: str, dtype: T.DataType) -> DataFrame:
    """Adds one value per class. The table has at most MAX_CLASSES rows, so it is broadcast."""
    if len(values) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    schema = T.StructType([T.StructField("_class", T.StringType()), T.StructField(name, dtype)])
    table = small_table(df.sparkSession, list(values.items()), schema)
    return df.join(F.broadcast(table), label_text(label) == F.col("_class"), "left").drop("_class")


def _find_cuts(
    keyed: DataFrame, counts: dict[str, int], quotas: dict[str, int], rank_limit: int, digits: int,
) -> dict[str, tuple[str, str]]:
    """Per class, the (hash, key) of its quota-th row in hash order."""
    # class -> (hash prefix that holds the wanted row, rows before it, rows in it)
    open_ = {c: ("", 0, counts[c]) for c, q in quotas.items() if 0 < q < counts[c]}
    length = 0
    while any(n > rank_limit for _, _, n in open_.values()) and length < 32:
        length += digits
        inside = attach_by_class(
            keyed, "c", {c: v for c, v in open_.items()}, "at",
            T.StructType([
                T.StructField("prefix", T.StringType()),
                T.StructField("before", T.LongType()),
                T.StructField("n", T.LongType()),
            ]),
        ).filter(F.col("h").startswith(F.col("at.prefix")))
        per_prefix = inside.groupBy("c", F.substring("h", 1, length).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n"), F.first("at.before").alias("offset"),
        )
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("prefix")) + F.col("offset")
        wanted = attach_by_class(
            per_prefix.withColumn("upto", upto), "c", quotas, "quota", T.LongType(),
        ).filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        open_ = {r.c: (r.prefix, r.upto - r.n, r.n) for r in wanted.collect()}
    if not open_:
        return {}
    inside = attach_by_class(
        keyed, "c", {c: (prefix, quotas[c] - before) for c, (prefix, before, _) in open_.items()}, "at",
        T.StructType([T.StructField("prefix", T.StringType()), T.StructField("rank", T.LongType())]),
    ).filter(F.col("h").startswith(F.col("at.prefix")))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("h", "k"))
    found = inside.withColumn("r", rank).filter(F.col("r") == F.col("at.rank")).collect()
    return {row.c: (row.h, row.k) for row in found}


def mark_by_quota(
    df: DataFrame, label: Column | str, quota: Callable[[dict[str, int]], dict[str, int]], name: str,
    seed: int = 42, key: str = KEY, rank_limit: int = RANK_LIMIT, digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Adds a boolean that is true on the first ``quota`` rows of each class in hash order.

    The key must be unique. The cuts are computed when this is called; the returned
    frame compares each row with its class's cut.
    """
    keyed = df.select(label_text(label).alias("c"), hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    counts = class_counts(keyed, "c")
    quotas = {c: max(0, min(q, counts[c])) for c, q in quota(counts).items()}
    cuts = _find_cuts(keyed, counts, quotas, rank_limit, digits)
    # "g" sorts after every hex digit: the cut of a class that is taken whole.
    values = {
        c: cuts.get(c, ("g", None) if quotas[c] > 0 else ("", None)) for c in quotas
    }
    cut_type = T.StructType([T.StructField("h", T.StringType()), T.StructField("k", df.schema[key].dataType)])
    marked = attach_by_class(df.withColumn("_label", label_text(label)), "_label", values, "_cut", cut_type)
    before = F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k")) <= F.col("_cut")
    return marked.withColumn(name, F.coalesce(before, F.lit(False))).drop("_cut", "_label")


def _share(n: int, share: float) -> int:
    return int((Decimal(str(share)) * n).to_integral_value(ROUND_HALF_UP))


def stratified_split(
    df: DataFrame, label: str, test: float = 0.2, seed: int = 42, key: str = KEY, mode: str = "exact",
    **limits,
) -> DataFrame:
    """Adds ``is_test``, keeping each class's share.

    ``exact`` takes round(test * n) rows of each class. ``hash`` decides each row by its
    hash alone: no extra pass, shares met only on average.
    """
    if mode == "hash":
        slot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
        return df.withColumn("is_test", slot < F.lit(int(test * 1_000_000)))
    if mode != "exact":
        raise ValueError("mode is 'exact' or 'hash'")
    return mark_by_quota(
        df, label, lambda counts: {c: _share(n, test) for c, n in counts.items()}, "is_test", seed, key, **limits,
    )


def undersample(
    df: DataFrame, label: str, seed: int = 42, key: str = KEY, min_size: int = 0, **limits,
) -> DataFrame:
    """Every class cut to the smallest class's size, without replacement.

    ``min_size`` leaves smaller classes as they are and sizes the others by the smallest
    class of at least that many rows.
    """
    def quota(counts: dict[str, int]) -> dict[str, int]:
        size = min((n for n in counts.values() if n >= min_size), default=0)
        return {c: min(n, size) if n >= min_size else n for c, n in counts.items()}

    return mark_by_quota(df, label, quota, "_keep", seed, key, **limits).filter("_keep").drop("_keep")


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = KEY, **limits) -> DataFrame:
    """n rows without replacement; the result stays distributed whatever n is."""
    marked = mark_by_quota(
        df, F.lit("all"), lambda counts: {c: n for c in counts}, "_keep", seed, key, **limits,
    )
    return marked.filter("_keep").drop("_keep")


def top_features(
    df: DataFrame, k: int = 10, value: str = "mean_abs", by: str | None = "class", feature: str = "feature",
) -> DataFrame:
    """The k features of largest value, per class or overall. The input has one row per (class, feature)."""
    order = [F.desc(value), F.col(feature)]
    if by is None:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], limit: int = 10_000, bins: int = 4096, accuracy: int = 10_000,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles, exact, without gathering a column in one task.

    Approximate quantiles bracket each wanted order statistic; one pass counts the rows
    below and inside every bracket. A bracket with many rows is cut into bins, of which
    the one that holds the wanted row is kept; a bracket that misses it is replaced by the
    whole range. When few rows are left their values are counted.
    """
    number = nan_to_null
    near = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in probs for side in (-1, 1)]
    stats = df.agg(*[
        F.struct(
            F.count(number(c)).alias("n"), F.min(number(c)).alias("lo"), F.max(number(c)).alias("hi"),
            F.percentile_approx(number(c), near, accuracy).alias("near"),
        ).alias(c)
        for c in cols
    ]).first()
    # Neighbouring 0-based ranks and the weight of the upper one, per column and probability.
    wanted, brackets = {}, {}
    for c in cols:
        for i, p in enumerate(probs if stats[c].n else []):
            at = p * (stats[c].n - 1)
            wanted[c, p] = int(at), min(int(at) + 1, stats[c].n - 1), at - int(at)
            brackets[c, p] = stats[c].near[2 * i], stats[c].near[2 * i + 1]
    if not wanted:
        return {c: [] for c in cols}
    counts = df.agg(*[
        F.struct(
            F.count_if(number(c) < lo).alias("below"), F.count_if(number(c).between(lo, hi)).alias("n"),
        ).alias(f"b{i}")
        for i, ((c, _), (lo, hi)) in enumerate(brackets.items())
    ]).first()
    # (column, lowest value, highest value, rows below, rows inside) -> ranks to find inside
    intervals: dict[tuple, set[int]] = {}
    for i, ((c, p), (lo, hi)) in enumerate(brackets.items()):
        below, n = counts[f"b{i}"]
        for rank in wanted[c, p][:2]:
            inside = below <= rank < below + n
            interval = (c, lo, hi, below, n) if inside else (c, stats[c].lo, stats[c].hi, 0, stats[c].n)
            intervals.setdefault(interval, set()).add(rank)
    found: dict[tuple[str, int], float] = {}
    while intervals:
        for (c, lo, hi, _, _), ranks in intervals.items():
            if lo == hi:
                found |= {(c, r): lo for r in ranks}
        intervals = _narrowed(df, {i: r for i, r in intervals.items() if i[1] < i[2]}, limit, bins)
    return {
        c: [
            found[c, lower] + (found[c, upper] - found[c, lower]) * weight
            for (name, _), (lower, upper, weight) in wanted.items() if name == c
        ]
        for c in cols
    }


def _narrowed(df: DataFrame, intervals: dict[tuple, set[int]], limit: int, bins: int) -> dict[tuple, set[int]]:
    """For each wanted rank the bin, or the single value, of its interval that holds it.

    There are a few intervals per column and probability, so they are literals of one
    narrow expression; rows outside all intervals leave no trace.
    """
    if not intervals:
        return {}
    cells = []
    for i, (c, lo, hi, below, n) in enumerate(intervals):
        v = nan_to_null(c)
        cell = F.floor((v - lo) / (hi - lo) * bins).cast("double") if n > limit else v
        cells.append(F.when(v.between(lo, hi), F.struct(
            F.lit(i).alias("id"), F.lit(below).cast("long").alias("below"), cell.alias("cell"), v.alias("v"),
        )))
    counted = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("id", "below", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
    )
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("cell")) + F.col("below")
    ranks = small_table(
        df.sparkSession, [(i, r) for i, wanted in enumerate(intervals.values()) for r in sorted(wanted)],
        "rank_id int, rank long",
    )
    hit = (F.col("id") == F.col("rank_id")) & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))
    column = [interval[0] for interval in intervals]
    narrowed: dict[tuple, set[int]] = {}
    for r in counted.withColumn("upto", upto).join(F.broadcast(ranks), hit).collect():
        narrowed.setdefault((column[r.id], r.lo, r.hi, r.upto - r.n, r.n), set()).add(r.rank)
    return narrowed
