"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import few_files, remove_path, scratch_dir


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node with an edge.

    ``edges`` has long ``a`` and ``b``. Alternates two steps that keep connectivity until
    nothing changes: every node points its larger neighbours, then its smaller ones, to the
    least neighbour. Each step aggregates with partial sums and joins back, so the edges of
    a hub are never gathered in one task; each result is a stored table.
    """
    spark = edges.sparkSession

    def stored(frame: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_dir(spark, "edges")
        few_files(frame.distinct()).write.parquet(path)
        kept = spark.read.parquet(path)
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return kept, path, tuple(state)

    # a larger, b smaller
    now, path, state = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(down.select("a", F.col("m").alias("b")))
        new, new_path, new_state = stored(small)
        remove_path(spark, path)
        done, (now, path, state) = new_state == state, (new, new_path, new_state)
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


class Union:
    """Disjoint sets of a few numbered things inside a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> list[int]:
        return [self.find(i) for i in range(len(self.up))]
