"""Repeated passages of words, found exactly behind a count-min prefilter.

A window is a run of ``width`` words. Of the short runs of words inside a window the one
with the least hash is its anchor; equal windows have equal anchors, so the count of the
anchor bounds that of the window from above. Tasks sketch the counts of their anchors,
the sketches are merged, and a second pass sends only windows whose anchor is estimated
to repeat, by 80-bit fingerprint, to an exact grouping. No repeated window is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import scratch_dir, ship_package
from .frames import dropping, schema_with
from .sketch import cell_bits, count_sketch, may_have, text_bytes
from .text import Texts, Words, blocks, mix, range_hashes, signed, window_hashes

ANCHOR_WORDS = 8
#: Bytes of text whose windows are compared in the task before they are sent.
LOCAL_BYTES = 6 << 20
#: Bytes of text to an anchor, about: six a word, two anchors in (width - ANCHOR_WORDS + 2) words.
_ANCHOR_BYTES = 80
CELLS_EACH = 16
DEPTH = 2
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = np.uint64(0xFFFFFFFF00000000)
_TWIN = np.uint64(0xD6E8FEB86659FD93)


def row_tag(docs: DataFrame, text: str, id_: str) -> Column:
    """Tells rows with one id apart by 64 bits of their text, zero (an int) where no id occurs
    twice; rows alike in both share their result."""
    unique = docs.groupBy(id_).count().filter("count > 1").isEmpty()
    return F.lit(0) if unique else F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def anchored_windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its anchor's place, and the hash of the run at each word."""
    short = min(ANCHOR_WORDS, width)
    runs = window_hashes(words.hashes, short)
    span = width - short + 1
    if len(runs) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), runs
    n = len(runs) - span + 1
    least = np.empty(n, np.int64)
    # a place takes the lower bits of a hash, so long texts go by pieces with fewer places
    most = int(_PLACE) + 1
    step = max(1, most - span + 1)
    for first in range(0, n, step):
        last = min(n, first + step)
        least[first:last] = first + _least_places(runs[first:last + span - 1], span)
    whole = np.zeros(len(words.hashes) + 1, np.int64)
    fits = words.last - words.first >= width
    np.add.at(whole, words.first[fits], 1)
    np.add.at(whole, words.last[fits] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole)[:n] > 0)
    return starts, least[starts], runs


def _least_places(runs: np.ndarray, span: int) -> np.ndarray:
    """The place of the run of least hash among each ``span`` runs."""
    least = (mix(runs) & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    return (least & _PLACE).astype(np.int64)


def combined(first: np.ndarray, second: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal fingerprints in one block, the first place stands for all with count two;
    the others, known to repeat, get a key of their own. Returns both keys and counts, so
    that a passage found everywhere gives one row a block to its group. ``apart`` keeps the
    own keys of unlike blocks from meeting, for some more bytes to send."""
    _, at, inverse, many = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(first), bool)
    lead[at] = True
    # equal first halves with unlike second halves are left to the grouping
    alike = second == second[at][inverse]
    known = alike & ~lead
    counts = np.where(alike & (many[inverse] > 1), 2, 1).astype(np.int32)
    shared = np.bincount(inverse, weights=known, minlength=len(at))[inverse] > 0
    counts[lead & ~shared] = 1
    counts[known] = 2
    # Own keys are small numbers, which cost little to send; where they meet, all are known.
    own = np.arange(len(first), dtype=np.uint64)
    if apart:
        own |= first.sum(dtype=np.uint64) & _BLOCK
    return np.where(known, own, first), np.where(known, np.uint64(0), second), counts


def grouped_repeats(records: DataFrame) -> DataFrame:
    """The records whose fingerprint is counted twice or more in all."""
    return records.withColumn("total", times_met()).filter("total >= 2").select("doc_id", "row", "place")


def times_met() -> Column:
    return F.sum(F.col("k2").bitwiseAND(3)).over(Window.partitionBy("k1", F.shiftright("k2", 2)))


def record_batch(k1: np.ndarray, k2: np.ndarray, n: np.ndarray, ids: pa.Array, rows: pa.Array, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    second = ((k2 & np.uint64(0xFFFF)).astype(np.int32) << 2) | n.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(k1)), pa.array(second), ids.cast(pa.int64()).take(pa.array(owner)), rows.take(pa.array(owner)), pa.array(place.astype(np.int64))],
        names=["k1", "k2", "doc_id", "row", "place"],
    )


def record_schema(docs: DataFrame) -> str:
    """``k1`` and the upper bits of ``k2`` are a fingerprint of 80 bits, the lowest two bits of
    ``k2`` how often it was met (once or more), the rest tells where."""
    return f"k1 long, k2 int, doc_id long, row {dict(docs.dtypes)['row']}, place long"


def repeated_windows(docs: DataFrame, width: int, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``doc_id, row, place``: the first word of each window that occurs more than once; ``docs`` has ``row``."""
    spark = docs.sparkSession
    bits = cell_bits(text_bytes(docs, text) / _ANCHOR_BYTES, CELLS_EACH)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in blocks(batches, text):
            starts, places, runs = anchored_windows(Texts.of(batch.column(text)).words(), width)
            yield runs[places[np.flatnonzero(np.diff(places, prepend=-1))]]

    sketch = spark.sparkContext.broadcast(count_sketch(docs.select(text), anchors, bits, DEPTH, 2))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, LOCAL_BYTES):
            words = Texts.of(batch.column(text)).words()
            starts, places, runs = anchored_windows(words, width)
            at = starts[may_have(sketch.value, runs[places], bits, DEPTH)]
            if not len(at):
                continue
            k1 = range_hashes(words.hashes, at, at + width)
            k2 = range_hashes(mix(words.hashes ^ _TWIN), at, at + width)
            k1, k2, n = combined(k1, k2, apart=True)
            owner = words.owners()[at]
            yield record_batch(k1, k2, n, batch.column(id_), batch.column("row"), owner, at - words.first[owner])

    return grouped_repeats(docs.select(id_, text, "row").mapInArrow(windows, record_schema(docs)))


def with_cuts(source: DataFrame, found: DataFrame, keep: Callable[[pa.RecordBatch], pa.RecordBatch], result: T.StructType, text: str, id_: str) -> DataFrame:
    """``keep`` on batches of ``source`` (with ``row``) whose column ``cuts`` lists each row's
    places in ``found``, or is null. Only texts that may have a place, by a sketch of
    the rows that do, are shuffled to meet them; the others are dealt with where they are read.
    """
    spark, path = source.sparkSession, scratch_dir(source.sparkSession, "cuts")
    if dict(source.dtypes)["row"] != "int":  # rows alike in id and text have the same places
        found = found.distinct()
    found.groupBy(F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row")).agg(F.collect_list("place").alias("cuts")).write.option("compression", "zstd").parquet(path)
    cuts = spark.read.parquet(path)
    bits = cell_bits(cuts.count(), CELLS_EACH)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (b.column(0).to_numpy().view(np.uint64) for b in batches)

    sketch = spark.sparkContext.broadcast(count_sketch(cuts.select(F.xxhash64("cut_id", "cut_row")), keys, bits, 1, 1))
    keyed = source.withColumn("cut_key", F.xxhash64(id_, "row"))
    kind = pa.list_(pa.int64())

    def chosen(batch: pa.RecordBatch, cut: bool) -> pa.RecordBatch:
        has = may_have(sketch.value, batch.column("cut_key").to_numpy().view(np.uint64), bits, 1)
        return batch.filter(pa.array(has == cut)).drop_columns(["cut_key"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            rows = chosen(batch, False).drop_columns(["row"])
            if rows.num_rows:
                yield keep(rows.append_column("cuts", pa.nulls(rows.num_rows, kind)))

    # texts travel packed
    def to_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = chosen(batch, True)
            packed = [None if t is None else pack(t) for t in rows.column(text).cast(pa.large_binary()).to_pylist()]
            yield rows.set_column(rows.schema.get_field_index(text), text, pa.array(packed, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in blocks(batches, text, LOCAL_BYTES // 4):
            whole_texts = [None if t is None else unpack(t) for t in batch.column(text).to_pylist()]
            yield from map(keep, blocks([batch.set_column(batch.schema.get_field_index(text), text, pa.array(whole_texts, pa.large_binary()))], text))

    packed = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in source.schema.fields])
    some = keyed.mapInArrow(to_cut, packed)
    met = some.join(cuts, some[id_].eqNullSafe(cuts["cut_id"]) & (some["row"] == cuts["cut_row"]), "left").drop("cut_id", "cut_row", "row")
    return keyed.mapInArrow(whole, result).unionByName(met.mapInArrow(cut, result))


def without_repeats(docs: DataFrame, width: int = 35, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Each document without the words that lie in a window occurring elsewhere too.

    Returns the input columns but the text, then ``n_words``, ``n_removed`` and ``kept``
    (the other words joined by one space). Windows are judged on the input. A null text has
    no words; a text shorter than ``width`` words keeps all. Repeated rows repeat each other;
    ids may be null or occur more than once. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    source = dropping(docs, "n_words", "n_removed", "kept", "row", "cuts", "cut_id", "cut_row", "cut_key")
    source = source.withColumn("row", row_tag(source, text, id_))
    found = repeated_windows(source, width, text, id_)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(batch.column(text))
        words = texts.words()
        lists = batch.column("cuts")
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        many = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        at = at + np.repeat(words.first, many)
        edge = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        stays = np.cumsum(edge)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(stays)])
        n_kept = before[words.last] - before[words.first]
        n_words = words.last - words.first
        rest = batch.drop_columns([text, "cuts"])
        return pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), _joined(texts.data, words, stays, n_kept)],
            names=[*rest.schema.names, "n_words", "n_removed", "kept"],
        )

    result = schema_with(source.drop("row"), "n_words long, n_removed long, kept string", without=text)
    return with_cuts(source, found, keep, result, text, id_)


def _joined(data: np.ndarray, words: Words, stays: np.ndarray, many: np.ndarray) -> pa.Array:
    """The staying words of each text with one space between them."""
    start, size = words.starts[stays], (words.stops - words.starts)[stays] + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(start - (ends - size), size)
    out = np.append(data, np.uint8(0))[source] if total else np.empty(0, np.uint8)
    if total:
        out[ends - 1] = ord(" ")
    last = np.concatenate([[0], ends])[np.cumsum(many)]
    first = np.concatenate([[0], last[:-1]])
    # each text ends before its last space
    raw = out.tobytes()
    return pa.array([raw[a:max(a, b - 1)].decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.string())
