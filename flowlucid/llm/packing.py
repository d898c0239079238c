"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best-fit: pieces are ordered by length, and each round takes all pieces
of one length, longest first, at once. Every piece asks for its successor among the open
gaps, the smallest one that holds it; where many ask for the same gap, ranks within the
length decide, the lowest ranks fill it; the gaps shrink, and the rest of the round asks
again. Lengths are whole numbers up to the capacity, so pieces of one length and gaps of
one size are runs: a round works on runs, whose number depends on the capacity and not on
the data, and the rows are only ranked and joined with the runs they fall into.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import scratch_dir, ship_package, small_table
from .frames import dropping, schema_with
from .text import blocks

CAPACITY = 2048
END_ID = 0
#: Words whose ids a task remembers at most; a full memory is emptied.
REMEMBERED = 900_000
#: Pieces that one rank group should hold.
GROUP_ROWS = 50_000


_WORD_END = re.compile(rb"(?<=[A-Za-z])(?=[!-@\[-`{-~])")


class WordIds:
    """The ids of texts by a tokenizer none of whose tokens spans ASCII white space, so
    that each distinct word is encoded once. Ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        names = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(names.values()) + 1, bool)
        self.is_end[[i for name, i in names.items() if name.endswith("</w>")]] = True

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Parts that the tokenizer keeps apart: at white space and between an ASCII letter
        and a sign after it, unless the text may hold the name of a special token. Small
        letters stand for capitals where nothing can combine with them."""
        if text.isascii():
            text = text.lower()
        return (text if b"<|" in text else _WORD_END.sub(b" ", text)).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        unknown = set().union(*split) - self.known.keys()
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known, unknown = {}, set().union(*split)
        self._learn(unknown)
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) for words in split]


    def _learn(self, words: set[bytes]) -> None:
        """Encodes words of letters many at a time, each ending with an end-of-word token;
        the others, and batches where the ends don't add up, one by one."""
        texts = {w: w.decode() for w in words}
        letters = [w for w, t in texts.items() if t.isalpha()]
        alone = [w for w, t in texts.items() if not t.isalpha()]
        for at in range(0, len(letters), 2000):
            part = letters[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[w] for w in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
            if len(ends) != len(part):
                alone += part
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.known[word] = raw[begin:end]
                begin = end
        for at in range(0, len(alone), 10_000):
            part = alone[at:at + 10_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([texts[w] for w in part], add_special_tokens=False), strict=True):
                self.known[word] = np.array(got.ids, "<u4").tobytes()


_encoders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The token ids of each document, ended by id 0, in pieces of at most ``capacity``.

    ``tokenizer`` is the path of a ``tokenizers`` file on the workers. Returns the input
    columns but the text, then ``piece`` (from 0), ``start`` (ids before it), ``length``,
    ``ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit). Only documents
    above the capacity are cut. A null or empty text is the end id alone.
    """
    ship_package(docs.sparkSession)
    added = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in added.split(", ")]
    source = dropping(docs, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordIds(tokenizer)
        for batch in blocks(batches, text):
            texts = batch.column(text).cast(pa.large_binary()).fill_null(b"").to_pylist()
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, found in enumerate(_encoders[tokenizer].encode(texts)):
                found += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    cut = found[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(cut)
            rest = batch.drop_columns([text]).take(pa.array(row, pa.int64())) if batch.num_columns > 1 else None
            made = [pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], *[pa.array(ids, pa.binary())] * with_ids]
            yield pa.RecordBatch.from_arrays([*(rest.columns if rest else []), *made], names=[*(rest.schema.names if rest else []), *names])

    return source.mapInArrow(run, schema_with(source, added, without=text))


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, last rank + 1, first sequence, pieces a sequence, offset)``.

    Rank ``r`` of a run goes to sequence ``first sequence + (r - first rank) // pieces a
    sequence``; ``offset`` is where the first piece of the run lies in each sequence.
    """
    runs, opened = [], 0
    sizes: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: runs of sequences (first, how many)

    def leave(size: int, first: int, many: int) -> None:
        if size and many:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, many = gaps[size].pop()
                if not gaps[size]:
                    sizes.pop(at)
            else:
                size, first, many = capacity, opened, -(-rest // (capacity // length))
                opened += many
            each = size // length
            used = min(many, rest // each)
            if used:
                runs.append((length, rank, rank + used * each, first, each, capacity - size))
                leave(size - each * length, first, used)
                rank, rest = rank + used * each, rest - used * each
            if used < many and rest:  # fewer than fill one more gap
                runs.append((length, rank, rank + rest, first + used, rest, capacity - size))
                leave(size - rest * length, first + used, 1)
                rank, rest, used = rank + rest, 0, used + 1
            leave(size, first + used, many - used)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to the capacity) plus ``sequence_id`` and ``offset``.

    Sequences are filled without gaps from 0. Pieces of one length are ranked in groups of
    bounded size, so a length that a third of the rows share is not sorted in one task.
    Repeated rows are packed each; an empty table gives an empty result. ``pieces`` is read
    three times and should be a stored table.
    """
    spark = pieces.sparkSession
    source = dropping(pieces, "sequence_id", "offset", "_group", "_rank")
    counts = {int(r[0]): int(r[1]) for r in source.groupBy("length").count().collect()}
    groups = max(1, -(-sum(counts.values()) // GROUP_ROWS))
    runs = small_table(spark, best_fit_rounds(counts, capacity), "length long, _first long, _last long, _sequence long, _each long, _offset long")
    spread = source.withColumn("_group", F.pmod(F.xxhash64(*order, *[c for c in ("ids_crc32",) if c in source.columns]), F.lit(groups)).cast("int"))
    before = (
        spread.groupBy("length", "_group").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_group", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    placed = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    inside = placed.join(runs, (placed["length"] == runs["length"]) & (placed["_rank"] >= runs["_first"]) & (placed["_rank"] < runs["_last"]))
    since = F.col("_rank") - F.col("_first")
    return inside.select(
        *[placed[f"`{c}`"] for c in source.columns],
        (F.col("_sequence") + F.floor(since / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + since % F.col("_each") * placed["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Documents tokenised, cut and packed: ``token_pieces`` stored once, then ``pack``."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "pieces")
    token_pieces(docs, tokenizer, capacity, text).write.parquet(path)
    return pack(spark.read.parquet(path), capacity)
