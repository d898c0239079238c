"""The k-th largest number of a distributed column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
FEW = 10_000


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """Counts in ever finer bins find the bin that holds it; only that bin's few numbers are
    looked at. None if there are not so many. Null and NaN don't count."""
    x = F.col(column).cast("double")
    values = values.select(x.alias("x")).filter("x is not null and not isnan(x)")
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    above = 0  # numbers over high
    while n > FEW and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)).cast("int") if width else F.lit(0)
        within = values.filter(F.col("x").between(low, high))
        for row in sorted(within.groupBy(place.alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect(), key=lambda r: -r.bin):
            if above + row.n >= k:
                break
            above += row.n
        low, high, n = row.low, row.high, row.n
    if low == high:
        return float(low)
    found = sorted((r.x for r in values.filter(F.col("x").between(low, high)).collect()), reverse=True)
    return found[k - above - 1]
