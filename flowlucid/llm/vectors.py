"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. Similar vectors have
nearly the same ones, so the index keeps inverted lists: one for each set of some (one to
six) pivots, with the vectors that have all of them among their nearest. Two vectors meet if
they share at least so many, and are then compared exactly. Pivots are taken from a bounded
sample, seen from its mean, so that a direction common to all vectors does not decide, and
lie apart from each other: many in one dense cluster would be ranked by noise alone. How far
apart, and how many must be shared, is chosen on the sample: of the choices that find vectors
just similar enough, the one whose lists are shortest. Every vector is indexed. Equal vectors
are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import scratch_dir, ship_package
from .frames import dropping
from .graph import Union, components
from .jaccard import by_group
from .text import mix, signed

COSINE = 0.98
#: Reference points of each vector length, chosen from the first ``SAMPLE`` distinct vectors
#: in hash order; a candidate whose cosine to a chosen one is over one of ``APART`` is passed over.
PIVOTS = 128
SAMPLE = 4096
APART = (0.8, 0.9, 0.95)
#: Pivots that two vectors must share to meet, most first.
SHARED = (6, 5, 4, 3, 2, 1)
#: Part of the pairs tried that a choice must find (half of them are only just similar, which are the
#: hardest to find), and sampled vectors it is tried with.
FOUND = 0.97
PROBES = 1024
#: Lengths with at most so many distinct vectors need no pivots: they meet in one list.
FEW = 256
NEAREST = 7
#: Vectors of one list that a task compares with as many others at once.
BLOCK = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    rows = flat.astype(np.float64).reshape(-1, width)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass(frozen=True)
class Pivots:
    """Reference points as seen from ``centre``, and how many of the nearest two vectors must share."""

    centre: np.ndarray
    points: np.ndarray
    shared: int

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """The numbers of each vector's nearest pivots, nearest first; of ties the lower number."""
        return np.argsort(-((units - self.centre) @ self.points.T), axis=1, kind="stable")[:, :NEAREST]


def apart_pivots(units: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first rows, ``most`` at most, whose cosine to the rows chosen before is at most ``apart``."""
    chosen, free = [], np.ones(len(units), bool)
    while len(chosen) < most and free.any():
        at = int(free.argmax())
        chosen.append(at)
        free &= units @ units[at] <= apart
        free[at] = False
    return units[chosen]


def similar_pairs(units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of vectors that a choice of pivots is tried with: similar ones among the
    sample, and each probe with one of cosine ``least`` in a random direction."""
    probes = units[:PROBES]
    a, b = np.nonzero(np.triu(probes @ units.T >= least, 1))
    some = np.linspace(0, len(a) - 1, min(len(a), 8 * PROBES)).astype(np.int64)
    aside = np.random.default_rng(0).normal(size=probes.shape)
    aside -= (aside * probes).sum(1, keepdims=True) * probes
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    other = least * probes + np.sqrt(max(0.0, 1 - least * least)) * aside / np.where(length > 0, length, 1)
    real = (units[a[some]], units[b[some]])
    # as many of one kind as of the other
    times = max(1, len(some) // max(1, len(probes)))
    return np.concatenate([real[0], *[probes] * times]), np.concatenate([real[1], *[other] * times])


def fit_pivots(units: np.ndarray, least: float = COSINE, most: int = PIVOTS) -> Pivots:
    """Pivots for vectors like the sample ``units``."""
    centre = units.mean(axis=0)
    seen = units - centre
    length = np.linalg.norm(seen, axis=1, keepdims=True)
    seen = (seen / np.where(length > 0, length, 1))[length[:, 0] > 0]
    if not len(seen):
        return Pivots(centre, np.eye(1, units.shape[1]), 1)
    left, right = similar_pairs(units, least)
    choices = []
    for apart in APART:
        points = apart_pivots(seen, most, apart)
        every = Pivots(centre, points, 1)
        own, a, b = every.nearest(units), every.nearest(left), every.nearest(right)
        common = (a[:, :, None] == b[:, None, :]).any(2).sum(1)
        for shared in SHARED:
            size = min(shared, own.shape[1])
            sizes = np.unique(shared_keys(own, size), return_counts=True)[1].astype(float)
            choices.append(((common >= size).mean(), (sizes * sizes).sum() / len(units) ** 2, Pivots(centre, points, size)))
        if len(points) == most:
            break  # wider bounds choose from the same sample what lies closer
    good = [c for c in choices if c[0] >= FOUND]
    return min(good, key=lambda c: c[1])[2] if good else max(choices, key=lambda c: c[0])[2]


def shared_keys(nearest: np.ndarray, size: int) -> np.ndarray:
    """A key for each set of ``size`` of a vector's nearest pivots."""
    ordered = np.sort(nearest, axis=1)
    return np.stack([_named(ordered[:, list(c)]) for c in combinations(range(ordered.shape[1]), size)], axis=1)


def _named(pivots: np.ndarray) -> np.ndarray:
    out = np.zeros(pivots.shape[:-1], np.uint64)
    for i in range(pivots.shape[-1]):
        out = mix(out * _STEP + pivots[..., i].astype(np.uint64) + np.uint64(1))
    return out


def least_shared(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The key of the lowest ``size`` pivots that two vectors share; all pairs share so many."""
    both = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(a.dtype).max)
    return _named(np.sort(both, axis=1)[:, :size])


def can_link(vector: str, label: str) -> Column:
    """Whether a row has a label and a finite vector that is not zero; never null."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_links(vectors: DataFrame, least: float = COSINE, pivots: int = PIVOTS, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The columns ``vec_id, n_links, component_id, kept`` for each row.

    Rows of one label whose cosine is ``least`` or more are linked. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the least id reachable, and ``kept``
    tells whether it is the row's own. Vectors that are null, empty, zero or not finite
    throughout, and rows without label, are linked with nothing; vectors of different
    length are never similar. A null id has no component. No rows give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    source = dropping(vectors, "n_links", "component_id", "kept", "entry", "many").select(F.col(id_).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    path = scratch_dir(spark, "vectors")
    # equal vectors are one entry, named by its hash; ids within a label
    source.filter(can_link("v", "label")).groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("many")).withColumn(
        "entry", F.xxhash64("label", "v"),
    ).write.parquet(path)
    entries = spark.read.parquet(path)

    def sampled(width: int, n: int) -> np.ndarray:
        # about twice the sample by hash alone, so that tasks send no more than that
        low = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 2 * SAMPLE / n)))
        rows = entries.filter((F.size("v") == width) & (F.col("entry") <= low)).orderBy("entry", "v").limit(SAMPLE).select("v").collect()
        return unit_rows(np.array([list(r.v) for r in rows]), width)

    many = entries.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).collect()
    sent = spark.sparkContext.broadcast({r.width: fit_pivots(sampled(r.width, r.n), least, pivots) for r in many})

    def points(width: int) -> Pivots:
        return sent.value[width] if width in sent.value else Pivots(np.zeros(width), np.eye(1, width), 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pa.compute.list_value_length(whole.column("v")).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == width))
                units = unit_rows(batch.column("v").flatten().to_numpy(), width)
                keys = shared_keys(points(width).nearest(units), points(width).shared)
                salted = mix(keys + np.uint64(width))
                row = np.repeat(np.arange(len(units)), keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(pa.array(row)), pa.array(signed(salted.ravel())), pa.array(signed(keys.ravel())), batch.column("entry").take(pa.array(row))],
                    names=["label", "list", "shared", "entry"],
                )

    kind = dict(entries.dtypes)["label"]
    path = scratch_dir(spark, "lists")
    entries.select("label", "v", "entry").mapInArrow(index, f"label {kind}, list long, shared long, entry long").write.parquet(path)
    lists = spark.read.parquet(path)
    parts = lists.groupBy("label", "list").agg(F.count("*").alias("n")).filter("n > 1").select("label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    own = F.pmod("entry", F.col("parts")).cast("int")
    dealt = lists.join(parts, ["label", "list"]).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "label", "list", "shared", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "entry",
    )
    keys = ["list", "p", "q", "label"]
    met = dealt.join(entries.select("label", "entry", "v", "many", "least_id"), ["label", "entry"]).select(*keys, "shared", "own", "entry", "v", "many")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, keys[:3]):
            labels = rows.column("label").to_numpy()
            for tag in np.unique(labels):
                part = rows.filter(pa.array(labels == tag)).combine_chunks()
                vectors_ = pa.compute.list_flatten(part.column("v")).to_numpy()
                units = unit_rows(vectors_, len(vectors_) // part.num_rows)
                entry, many = part.column("entry").to_numpy(), part.column("many").to_numpy()
                p, q, shared = (part.column(c)[0].as_py() for c in ("p", "q", "shared"))
                owner = part.column("own").to_numpy()
                known = points(units.shape[1])
                nearest = known.nearest(units)
                a, b = np.nonzero(np.triu(units @ units.T >= least, 1))
                if p != q:
                    apart = owner[a] != owner[b]
                    a, b = a[apart], b[apart]
                links, joined = np.zeros(len(units), np.int64), Union(len(units))
                for at in range(0, len(a), 1 << 18):
                    x, y = a[at:at + (1 << 18)], b[at:at + (1 << 18)]
                    once = least_shared(nearest[x], nearest[y], known.shared) == np.array([shared]).astype(np.int64).view(np.uint64)[0]
                    x, y = x[once], y[once]
                    np.add.at(links, x, many[y])
                    np.add.at(links, y, many[x])
                    for i, j in zip(x.tolist(), y.tolist(), strict=True):
                        if joined.up[i] != joined.up[j]:
                            joined.join(i, j)
                some = np.flatnonzero(links)
                to = entry[np.array(joined.roots())[some]] if len(some) else some
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(some), part.column("label").type), pa.array(entry[some]), pa.array(links[some]), pa.array(to, pa.int64())], names=["label", "entry", "links", "to"])

    path = scratch_dir(spark, "found")
    met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, f"label {kind}, entry long, links long, to long").write.parquet(path)
    found = spark.read.parquet(path)
    ids = entries.select("label", "entry", "least_id")
    edges = found.select("label", "entry", "to").distinct().join(ids.withColumnRenamed("least_id", "a"), ["label", "entry"]).select("label", "a", F.col("to").alias("entry")).join(ids.withColumnRenamed("least_id", "b"), ["label", "entry"])
    reached = components(edges.filter("a is not null and b is not null").select("a", "b"))
    counted = found.groupBy("label", "entry").agg(F.sum("links").alias("links"))
    of_entry = entries.join(counted, ["label", "entry"], "left").join(reached, entries["least_id"] == reached["node"], "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "least_id").alias("component"),
    )
    valid = source.filter(can_link("v", "label")).join(of_entry, ["label", "v"]).select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    rest = source.filter(~can_link("v", "label")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
