"""Repeated byte strings by prefix-free parsing.

A rolling hash over ``TRIGGER_BYTES`` bytes cuts each text into phrases: a phrase runs
from one trigger through the next, so no phrase is a prefix of another and equal strings
are cut alike wherever they stand. Suffixes in corpus order are suffixes of dictionary
phrases followed by what the parse says comes next; a string occurs again exactly if its
suffix and a neighbour in that order share the string's length. The order is put together
in three steps, each on what the step before left open:

1. dictionary: phrases that occur once are found by a count sketch; no string that holds
   one whole can occur again, which settles nearly all unique text;
2. parse: all strings that start in one phrase are one block, the phrase with the text up
   to the reach of its last string. Blocks that occur twice are settled as a whole, which
   makes highly repetitive text cheap: one row for a phrase and not one for each byte;
3. suffixes: for blocks found once, the strings starting at each byte of the phrase, that
   is dictionary suffix and what follows, are grouped one by one with the equal ones.

Only equality of neighbours matters here, so suffixes are ordered by 80-bit fingerprint
of their first ``width`` bytes instead of by alphabet; equal ones are neighbours in either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import release_shuffles, scratch_dir, ship_package
from .frames import dropping, schema_with
from .repeats import DEPTH, combined, grouped_repeats, record_batch, record_schema, row_tag, times_met, with_cuts
from .sketch import cell_bits, count_sketch, may_have, text_bytes
from .text import VALUES, Texts, blocks, hashes_between, range_hashes, running_sums

TRIGGER_BYTES = 8
#: Mean bytes from one trigger to the next.
PHRASE_BYTES = 16
CELLS_EACH = 8
#: Bytes of text parsed at once; a parse takes some twenty times as much.
PARSED_BYTES = 2 << 20
#: Bytes of text cut into phrases at a time, few enough to stay in a core's cache.
_CUT_BYTES = 1 << 17
#: Hashes a task counts at a time.
COUNTED = 1_000_000
_SALT, _ODD = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def trigger_places(data: np.ndarray, phrase: int) -> np.ndarray:
    """Where the hash of the next ``TRIGGER_BYTES`` bytes is small."""
    found = []
    few = np.uint64((1 << 64) // phrase)
    for low in range(0, len(data), _CUT_BYTES):
        part = data[low:low + _CUT_BYTES + TRIGGER_BYTES - 1].tobytes()
        small = np.zeros(len(part), bool)
        for shift in range(min(TRIGGER_BYTES, max(0, len(part) - TRIGGER_BYTES + 1))):
            at = np.frombuffer(part, "<u8", (len(part) - shift) // TRIGGER_BYTES, shift) ^ _SALT
            at *= _ODD  # the upper bits, which depend on all others
            np.less(at, few, out=small[shift:shift + len(at) * TRIGGER_BYTES:TRIGGER_BYTES])
        found.append(np.flatnonzero(small) + low)
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass
class Parse:
    """The phrases and blocks of some texts."""

    texts: Texts
    width: int
    triggers: np.ndarray
    phrase_from: np.ndarray  # triggers that begin a phrase
    block_from: np.ndarray
    block_upto: np.ndarray  # past the last string's start

    @classmethod
    def of(cls, texts: Texts, width: int, phrase: int) -> Parse:
        triggers = trigger_places(texts.data, phrase)
        text = np.searchsorted(texts.starts, triggers, side="right") - 1
        # of texts that start alike the last one is not empty
        inside = triggers + TRIGGER_BYTES <= texts.stops[text] if len(triggers) else np.empty(0, bool)
        triggers, text = triggers[inside], text[inside]
        begins = np.flatnonzero(text[:-1] == text[1:])
        ends = texts.stops - width + 1  # past the last string's start in each text
        long = texts.starts < ends
        starts = np.sort(np.concatenate([triggers, texts.starts[long]]), kind="stable")
        starts = starts[np.diff(starts, prepend=-1) > 0]
        owner = np.searchsorted(texts.starts, starts, side="right") - 1
        upto = np.minimum(np.append(starts[1:], len(texts.data)), ends[owner]) if len(starts) else starts
        some = starts < upto
        return cls(texts, width, triggers, begins, starts[some], upto[some])

    @cached_property
    def sums(self) -> np.ndarray:
        return running_sums(self.texts.data, VALUES[0])

    def phrase_hashes(self) -> np.ndarray:
        return hashes_between(self.sums, self.triggers[self.phrase_from], self.triggers[self.phrase_from + 1] + TRIGGER_BYTES)

    def keys(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes_between(self.sums, starts, stops), range_hashes(self.texts.data, starts, stops, VALUES[1])

    def open_blocks(self, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks with a string that may occur again, as no phrase inside it is known to occur
        once: from, past the last start; first and past the last start of such strings, which
        are together. ``repeats`` goes with ``phrase_from``."""
        once = self.phrase_from[~repeats]
        # A string holds the next phrase found once if it starts no earlier than this; one
        # number for each trigger as the string's first, rising.
        closed = np.append(self.triggers[once + 1] + TRIGGER_BYTES - self.width, len(self.texts.data))
        closed = closed[np.searchsorted(once, np.arange(len(self.triggers) + 1))]
        first = np.searchsorted(self.triggers, self.block_from)
        after = np.searchsorted(self.triggers, self.block_from, side="right")
        start = self.block_from + (closed[first] <= self.block_from)
        upto = np.minimum(self.block_upto, closed[after])
        some = start < upto
        return self.block_from[some], self.block_upto[some], start[some], upto[some]


def _records(batch: pa.RecordBatch, id_: str, texts: Texts, k1: np.ndarray, k2: np.ndarray, at: np.ndarray, upto: np.ndarray, each: np.ndarray | int = 1) -> pa.RecordBatch:
    k1, k2, n = combined(k1, k2)
    n = np.maximum(n, each).astype(np.int32)
    owner = np.searchsorted(texts.starts, at, side="right") - 1
    place = (at - texts.starts[owner]).astype(np.int64) << 31 | (upto - at)
    return record_batch(k1, k2, n, batch.column(id_), batch.column("row"), owner, place)


def repeated_starts(docs: DataFrame, width: int, phrase: int = PHRASE_BYTES, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``doc_id, row, place``: runs of bytes at which strings of ``width`` bytes start that occur
    again, as first byte times 2^31 plus length; ``docs`` has ``row``."""
    spark, size = docs.sparkSession, text_bytes(docs, text)
    source = docs.select(id_, text, "row")
    bits = cell_bits(size / phrase, CELLS_EACH)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Parse]]:
        for batch in blocks(batches, text, PARSED_BYTES):
            yield batch, Parse.of(Texts.of(batch.column(text)), width, phrase)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (p.phrase_hashes() for _, p in parsed(batches))

    dictionary = spark.sparkContext.broadcast(count_sketch(docs.select(text), phrases, bits, 1, 2, COUNTED))

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, p in parsed(batches):
            start, upto, first, past = p.open_blocks(may_have(dictionary.value, p.phrase_hashes(), bits, 1))
            if len(start):
                yield batch, p, start, upto, first, past

    def block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, start, upto, _, _ in open_blocks(batches):
            yield _records(batch, id_, p.texts, *p.keys(start, upto + width - 1), start, upto)

    path = scratch_dir(spark, "blocks")
    met_once = F.col("total") < 2
    source.mapInArrow(block_records, record_schema(source)).withColumn("total", times_met()).select(
        F.when(met_once, F.col("k1")).alias("single"), *[F.when(~met_once, F.col(c)).alias(c) for c in ("doc_id", "row", "place")],
    ).write.option("compression", "zstd").parquet(path)
    settled = spark.read.parquet(path)
    release_shuffles(spark)
    singles = settled.filter("single is not null").select("single")
    few = cell_bits(singles.count(), 16)

    def single_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (b.column(0).to_numpy().view(np.uint64) for b in batches)

    single = spark.sparkContext.broadcast(count_sketch(singles, single_keys, few, 1, 1, COUNTED))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Open starts in batches, and which of them lie in single blocks."""
        for batch, p, start, upto, first, past in open_blocks(batches):
            picked = may_have(single.value, hashes_between(p.sums, start, upto + width - 1), few, 1)
            many = past - first
            yield batch, p, np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many), np.repeat(picked, many)

    def string_keys(p: Parse, at: np.ndarray) -> np.ndarray:
        return hashes_between(p.sums, at, at + width)

    wide = cell_bits(size / 16, 8)

    def single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (string_keys(p, at[own]) for _, p, at, own in suffixes(batches))

    asked = spark.sparkContext.broadcast(count_sketch(docs.select(text), single_strings, wide, DEPTH, 1, COUNTED))

    # A string of a single block may also stand in a settled block. That one is counted
    # twice, as it is known to repeat, and sent once from each batch.
    def met(p: Parse, at: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k1 = string_keys(p, at)
        some = may_have(sketch, k1, wide, DEPTH)
        other = np.flatnonzero(some & ~own)
        other = other[np.unique(k1[other], return_index=True)[1]]
        some &= own
        some[other] = True
        return at[some], k1[some], own[some]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, p, at, own in suffixes(batches):
            _, k1, own = met(p, at, own, asked.value)
            yield np.concatenate([k1, k1[~own]])

    wanted = spark.sparkContext.broadcast(count_sketch(docs.select(text), counted, wide, DEPTH, 2, COUNTED))
    # What is wanted was asked for; a settled string taken for one is known to repeat anyway.
    asked.unpersist()

    def suffix_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, at, own in suffixes(batches):
            at, k1, own = met(p, at, own, wanted.value)
            if len(at):
                k2 = range_hashes(p.texts.data, at, at + width, VALUES[1])
                yield _records(batch, id_, p.texts, k1, k2, at, at + 1, np.where(own, 1, 2))

    strings, found = grouped_repeats(source.mapInArrow(suffix_records, record_schema(source))), scratch_dir(spark, "strings")
    strings.write.option("compression", "zstd").parquet(found)
    del strings
    for sketch in (dictionary, single, wanted):
        sketch.unpersist()
    release_shuffles(spark)
    return settled.filter("single is null").select("doc_id", "row", "place").unionByName(spark.read.parquet(found))


def without_repeated_bytes(docs: DataFrame, width: int = 200, phrase: int = PHRASE_BYTES, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Each document without the bytes covered by a string of ``width`` bytes that also starts elsewhere.

    Returns the input columns but the text, then ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept`` (binary: a cut may fall inside a character). Strings
    are judged on the input and never cross documents. A null text is empty; repeated rows
    repeat each other; ids may be null or occur more than once; no rows give no rows.
    """
    ship_package(docs.sparkSession)
    source = dropping(docs, "n_bytes", "n_removed", "n_spans", "kept", "row", "cuts", "cut_id", "cut_row", "cut_key")
    source = source.withColumn("row", row_tag(source, text, id_))
    found = repeated_starts(source, width, phrase, text, id_)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(batch.column(text))
        lists = batch.column("cuts")
        runs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        many = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        at = (runs >> 31) + np.repeat(texts.starts, many)
        edge = np.zeros(len(texts.data) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + (runs & ((1 << 31) - 1)) + width - 1, -1)
        gone = np.cumsum(edge)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        begins = texts.starts[texts.starts < texts.stops]
        first[begins] = gone[begins]
        removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, first))
        kept = texts.data[~gone].tobytes()
        ends = texts.stops - removed[texts.stops]
        starts = texts.starts - removed[texts.starts]
        rest = batch.drop_columns([text, "cuts"])
        made = [texts.stops - texts.starts, removed[texts.stops] - removed[texts.starts], spans[texts.stops] - spans[texts.starts]]
        return pa.RecordBatch.from_arrays(
            [*rest.columns, *[pa.array(x.astype(np.int64)) for x in made], pa.array([kept[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
            names=[*rest.schema.names, "n_bytes", "n_removed", "n_spans", "kept"],
        )

    result = schema_with(source.drop("row"), "n_bytes long, n_removed long, n_spans long, kept binary", without=text)
    return with_cuts(source, found, keep, result, text, id_)
