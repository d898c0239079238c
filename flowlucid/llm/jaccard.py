"""Similar documents by the Jaccard similarity of word n-grams, found exactly.

Equal sets are one node. A partition first brings together what can be similar: of any
order of the n-grams, two similar sets share one among their first few, and their sizes
lie in one class or in neighbouring ones. N-grams that a count sketch knows to occur once come
first in that order and frequent ones last, so that chance and lines found everywhere bring
nothing together. The sets that meet are joined by signature
trees: leaves hold a few sets, nodes the OR of their token bitmaps and the range of sizes;
a dual traversal drops pairs of nodes whose greatest possible overlap is too small, and
what is left is compared exactly. Links come out as components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import few_files, scratch_dir, ship_package
from .frames import dropping, schema_with
from .graph import Union, components
from .sketch import cell_bits, count_sketch, may_have, text_bytes
from .text import Texts, blocks, mix, range_hashes, signed, window_hashes

WORDS = 4
#: Intersection by union, in percent, from which two sets are similar.
PERCENT = 85
#: Frequent n-grams put last in the order, at most; which ones they are changes no result.
HOT = 1 << 16
#: An n-gram is reported as frequent by a task that sees it in so many of its documents.
OFTEN = 6
#: Bitmaps have about so many bits for each member of a set, within bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 64, 1 << 16
LEAF = 16
FAN = 8
#: Sets, and members of sets, that one task compares at once.
BLOCK_SETS, BLOCK_MEMBERS = 1024, 500_000
#: Bytes of text looked through at once: words and what they are hashed from take some 20 times as many.
TEXT_BYTES = 1 << 20
_SALT = np.uint64(0x94D049BB133111EB)


def ngram_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = texts.words(lower=True)
    grams = window_hashes(words.hashes, n)
    few = np.flatnonzero((words.last > words.first) & (words.last - words.first < n))
    whole = dict(zip(few.tolist(), range_hashes(words.hashes, words.first[few], words.last[few]) ^ _SALT, strict=True))
    out = []
    for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
        out.append(np.unique(grams[a:b - n + 1]) if b - a >= n else np.array([whole[i]] if b > a else [], np.uint64))
    return out


def batch_sets(batch: pa.RecordBatch, n: int, text: str = "text") -> list[np.ndarray]:
    """``ngram_sets`` of a batch's texts, made from at most ``TEXT_BYTES`` (or one text) at a time."""
    return [s for part in blocks(iter([batch]), text, TEXT_BYTES) for s in ngram_sets(Texts.of(part.column(text)), n)]


def set_key(members: np.ndarray) -> tuple[int, int]:
    """96 bits that name a set."""
    with np.errstate(over="ignore"):
        low, high = mix(members).sum(dtype=np.uint64), mix(members ^ _SALT).sum(dtype=np.uint64)
        pair = mix(np.array([low + np.uint64(len(members)), high], np.uint64))
    return int(pair.view(np.int64)[0]), int((pair[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))


def size_class(size: int, percent: int = PERCENT) -> int:
    """Sizes within the required ratio lie in one class or in two that follow each other."""
    return int(np.floor(np.log(size) / np.log(100 / percent) + 1e-9))


def meeting_keys(members: np.ndarray, again: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A key for each of the first n-grams that may stand in another set, and each of two size
    classes. The order is: those surely found once, others, frequent ones; each by value."""
    n = len(members)
    shared = members[again]
    at = np.searchsorted(hot, shared)
    frequent = hot[np.minimum(at, len(hot) - 1)] == shared if len(hot) else np.zeros(len(shared), bool)
    first = np.concatenate([shared[~frequent], shared[frequent]])[:max(0, n - -(-percent * n // 100) + 1 - (n - len(shared)))]
    c = size_class(n, percent)
    return np.concatenate([mix(first + np.uint64(c + k) * _SALT) for k in (0, 1)])


def bitmap(members: np.ndarray) -> np.ndarray:
    """64-bit words with one bit for each member's low bits."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(members) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(members & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


@dataclass
class SignatureTree:
    """Levels from the leaves up; a node holds sets ``first`` to ``last`` in order of size."""

    sizes: np.ndarray
    bits: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # first, OR of bits, least size, slack

    @classmethod
    def of(cls, sizes: np.ndarray, bits: np.ndarray) -> SignatureTree:
        slack = sizes - np.bitwise_count(bits).sum(1)
        first = np.arange(0, len(sizes), LEAF)
        levels = [(first, np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(sizes, first), np.maximum.reduceat(slack, first))]
        while len(levels[-1][0]) > 1:
            lower = levels[-1]
            at = np.arange(0, len(lower[0]), FAN)
            levels.append((lower[0][at], np.bitwise_or.reduceat(lower[1], at), np.minimum.reduceat(lower[2], at), np.maximum.reduceat(lower[3], at)))
        return cls(sizes, bits, levels)

    def last(self, level: int, node: int) -> int:
        first = self.levels[level][0]
        return int(first[node + 1]) if node + 1 < len(first) else len(self.sizes)

    def leaf_pairs(self, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that a dual traversal from the root cannot rule out: the sizes can
        be near enough, and the bits shared by both ORs leave enough possible overlap."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, u, v = stack.pop()
            first, ors, least, slack = self.levels[level]
            if u != v:
                most_u = self.sizes[self.last(level, u) - 1]
                if 100 * most_u < percent * least[v]:
                    continue
                common = int(np.bitwise_count(ors[u] & ors[v]).sum())
                if (100 + percent) * (common + min(slack[u], slack[v])) < percent * (least[u] + least[v]):
                    continue
            if level == 0:
                yield u, v
                continue
            below = len(self.levels[level - 1][0])
            for a in range(u * FAN, min(u * FAN + FAN, below)):
                stack.extend((level - 1, a, b) for b in range(max(a, v * FAN), min(v * FAN + FAN, below)))


def linked(sizes: np.ndarray, bits: list[np.ndarray], similar: Callable[[int, int], bool] | None, percent: int = PERCENT) -> list[int]:
    """For each set the number of the least one it is linked to, directly or not. Without
    ``similar``, all pairs that the bitmaps cannot rule out are links. Pairs that are already
    connected need no comparison."""
    order = np.argsort(sizes, kind="stable")
    words = min(len(b) for b in bits)
    tree = SignatureTree.of(sizes[order], np.stack([_folded(bits[i], words) for i in order]))
    joined, ones = Union(len(sizes)), np.bitwise_count(tree.bits).sum(1)
    for u, v in tree.leaf_pairs(percent):
        a, b = (np.arange(tree.levels[0][0][x], tree.last(0, x)) for x in (u, v))
        if len({joined.find(int(i)) for i in (*a, *b)}) == 1:
            continue
        common = np.bitwise_count(tree.bits[a][:, None] & tree.bits[b][None]).sum(2)
        most = np.minimum((tree.sizes[a] - ones[a])[:, None], (tree.sizes[b] - ones[b])[None]) + common
        near = (100 + percent) * most >= percent * (tree.sizes[a][:, None] + tree.sizes[b][None])
        near &= 100 * np.minimum(tree.sizes[a][:, None], tree.sizes[b][None]) >= percent * np.maximum(tree.sizes[a][:, None], tree.sizes[b][None])
        for i, j in np.argwhere(near):
            x, y = int(a[i]), int(b[j])
            if x < y and joined.find(x) != joined.find(y) and (similar is None or similar(int(order[x]), int(order[y]))):
                joined.join(x, y)
    out = np.empty(len(sizes), np.int64)
    roots = np.array(joined.roots())
    least = np.full(len(sizes), len(sizes))
    np.minimum.at(least, roots, order)
    out[order] = least[roots]
    return out.tolist()


def similar_enough(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (100 + percent) * both >= percent * (len(a) + len(b))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group that is together in its partition."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edges = [0, *(1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:], strict=False):
            part = batch.slice(first, last - first)
            if pending and any(pending[-1].column(k)[-1] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(part)
    if pending:
        yield pa.Table.from_batches(pending)


def _numbers(batch: pa.RecordBatch, owners: list[int], sets: list[np.ndarray], keys: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([keys[i][0] for i in owners], pa.int64()), pa.array([keys[i][1] for i in owners], pa.int32()), pa.array([len(sets[i]) for i in owners], pa.int32())]


def similar_sets(docs: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """``h1, h2, g1, g2``: edges between named sets that connect all similar ones."""
    spark, size = docs.sparkSession, text_bytes(docs, text)
    texts = docs.select(text)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in blocks(batches, text):
            yield batch, [s for s in batch_sets(batch, words, text) if len(s)]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            if sets:
                gram, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(gram[n >= OFTEN])), pa.array(n[n >= OFTEN])], names=["gram", "n"])

    counted = texts.mapInArrow(often, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.gram for r in counted.orderBy(F.desc("n"), "gram").limit(HOT).collect()], np.int64).view(np.uint64)))

    def all_members(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in sets_of(batches):
            yield np.concatenate([np.empty(0, np.uint64), *{set_key(s): s for s in sets}.values()])

    bits = cell_bits(size / 6, 3)
    shared = spark.sparkContext.broadcast(count_sketch(texts, all_members, bits, 1, 2))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in sets_of(batches):
            names = [set_key(s) for s in sets]
            named = {k: i for i, k in enumerate(names)}
            found, owners = [np.empty(0, np.uint64)], []
            for i in named.values():
                keys = meeting_keys(sets[i], may_have(shared.value, sets[i], bits, 1), hot.value, percent)
                found.append(keys)
                owners += [i] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), *_numbers(batch, owners, sets, names)], names=["key", "h1", "h2", "n"])

    path = scratch_dir(spark, "meetings")
    texts.mapInArrow(meetings, "key long, h1 long, h2 int, n int").write.parquet(path)
    met = spark.read.parquet(path)
    lists = met.groupBy("key").agg(F.min(F.struct("n", "h1", "h2")).alias("lead"), F.max(F.struct("n", "h1", "h2")).alias("other")).filter("lead <> other")
    # all that meet the same smallest set are compared together, once
    path = scratch_dir(spark, "clusters")
    few_files(met.join(lists, "key").select(F.col("lead.h1").alias("l1"), F.col("lead.h2").alias("l2"), "h1", "h2", "n").distinct()).write.parquet(path)
    clusters = spark.read.parquet(path)
    many = clusters.groupBy("l1", "l2").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("parts"))
    own = F.pmod(F.col("h2"), F.col("parts"))
    dealt = clusters.join(many, ["l1", "l2"]).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "l1", "l2", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "h1", "h2", "n",
    )

    def contents(wanted: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
        """``h1, h2, content`` of the wanted sets, read from the texts again."""
        few = cell_bits(wanted.count(), 16)
        sketch = spark.sparkContext.broadcast(count_sketch(wanted.select("h1"), lambda bs: (b.column(0).to_numpy().view(np.uint64) for b in bs), few, 1, 1))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sets in sets_of(batches):
                named = {set_key(s): s for s in sets}
                keys = list(named)
                yes = may_have(sketch.value, np.array([k[0] for k in keys], np.int64).view(np.uint64), few, 1)
                keys = [k for k, y in zip(keys, yes, strict=True) if y]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([make(named[k]) for k in keys], pa.binary())], names=["h1", "h2", "content"])

        sent = texts.mapInArrow(send, "h1 long, h2 int, content binary")
        return sent.groupBy("h1", "h2").agg(F.first("content").alias("content"))

    group = ["l1", "l2", "p", "q"]

    def compared(frame: DataFrame, keys: list[str], exact: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in by_group(batches, keys):
                if rows.num_rows < 2:
                    continue
                content = [np.frombuffer(c, np.uint64) for c in rows.column("content").to_pylist()]
                sizes = rows.column("n").to_numpy().astype(np.int64)
                maps = [bitmap(c) for c in content] if exact else content
                least = linked(sizes, maps, (lambda i, j: similar_enough(content[i], content[j], percent)) if exact else None, percent)
                many = np.bincount(least, minlength=len(least))[least]
                at = [i for i in range(len(least)) if many[i] > 1]
                to = [least[i] for i in at]
                out = rows.select([*group, "h1", "h2", "n"]).combine_chunks().take(pa.array(at, pa.int64()))
                ends = rows.select(["h1", "h2"]).combine_chunks().take(pa.array(to, pa.int64()))
                for batch in out.append_column("g1", ends.column("h1")).append_column("g2", ends.column("h2")).to_batches():
                    yield batch

        # every group goes to one task, sorted so that it is together there
        return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "l1 long, l2 int, p int, q int, h1 long, h2 int, n int, g1 long, g2 int")

    likely_path = scratch_dir(spark, "likely")
    few_files(compared(dealt.join(contents(clusters.select("h1", "h2").distinct(), lambda s: bitmap(s).tobytes()), ["h1", "h2"]), group, False)).write.parquet(likely_path)
    likely = spark.read.parquet(likely_path)
    with_sets = likely.join(contents(likely.select("h1", "h2").distinct(), lambda s: s.tobytes()), ["h1", "h2"])
    return compared(with_sets, [*group, "g1", "g2"], True).select("h1", "h2", "g1", "g2").filter("h1 <> g1 or h2 <> g2").distinct()


def with_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The input columns but the text, then ``n_shingles`` and ``component_id``, the least id
    among the documents linked to it, itself included.

    A text of fewer than ``words`` words is one n-gram; null and blank texts have none and
    are linked with nothing. Equal sets are linked, also of repeated rows; sets that only null ids have link nothing,
    and such rows have no component. No rows give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = dropping(docs, "n_shingles", "component_id", "h1", "h2")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            sets = batch_sets(batch, words, text)
            names = [set_key(s) if len(s) else (None, None) for s in sets]
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in names], pa.int64()), pa.array([k[1] for k in names], pa.int32())],
                names=[*rest.schema.names, "n_shingles", "h1", "h2"],
            )

    path = scratch_dir(spark, "sets")
    source.mapInArrow(name, schema_with(source, "n_shingles long, h1 long, h2 int", without=text)).write.parquet(path)
    named = spark.read.parquet(path)
    least = named.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(id_).alias("rep"))
    path = scratch_dir(spark, "links")
    few_files(similar_sets(source, words, percent, text)).write.parquet(path)
    links = spark.read.parquet(path)
    ends = links.join(least, ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("g1").alias("h1"), F.col("g2").alias("h2")).join(least, ["h1", "h2"]).select("a", F.col("rep").alias("b"))
    found = components(ends.filter("a is not null and b is not null"))
    of_set = least.join(found, least["rep"] == found["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("of_set"))
    return named.join(of_set, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("of_set", F.col(id_))).select(*[c for c in named.columns if c not in ("h1", "h2")], "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, of rows alike in
    id and text any one. Rows without words, and null ids that no other id is linked to, stay.
    """
    tagged = docs.withColumn("_row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    path = scratch_dir(docs.sparkSession, "components")
    few_files(with_components(tagged.select(id_, text, "_row"), words, percent, text, id_)).write.parquet(path)
    found = docs.sparkSession.read.parquet(path).filter("n_shingles > 0 and component_id is not null")
    other = found.filter(~F.col(id_).eqNullSafe(F.col("component_id"))).select(F.col(id_).alias("_id"), F.col("_row").alias("_tag")).distinct()
    left = tagged.join(other, tagged[id_].eqNullSafe(other["_id"]) & (tagged["_row"] == other["_tag"]), "left_anti")
    again = found.groupBy(id_, "_row").count().filter("count > 1")
    if not again.isEmpty():
        again = again.select(F.col(id_).alias("_id"), F.col("_row").alias("_tag"))
        alike = tagged[id_].eqNullSafe(again["_id"]) & (tagged["_row"] == again["_tag"])
        left = left.join(again, alike, "left_anti").union(left.join(again, alike, "left_semi").dropDuplicates([id_, "_row"]))
    return left.drop("_row")
