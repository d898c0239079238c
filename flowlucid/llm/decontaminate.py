"""Benchmark passages in documents, by q-gram lemma filtering.

A passage of m characters with at most k edits shares at least m - q + 1 - q k of its
q-grams with what it came from, all near one diagonal. Tasks look up the q-grams of their
texts in an index of the benchmark, count hits in overlapping bands of diagonals, and
align only the bands that reach the bound. Items of fewer than q characters have no q-gram
and are looked up whole. Of a long item overlapping passages of fixed length are looked for
too, so a text with a good part of it is found. The benchmark is the stated query set: it is
taken in blocks of bounded size, each sent to all tasks, however large it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import ship_package
from .frames import schema_with
from .text import Texts, blocks, mix

Q = 6
#: Edits allowed for each character of a benchmark item.
EDIT_RATE = 0.08
#: Characters of a passage of a longer item, and from one passage to the next: a text with any
#: ``PASSAGE + STEP - 1`` characters of an item running holds a whole passage.
PASSAGE = 100
STEP = 50
#: Characters of benchmark text whose index is sent to the tasks at once (some 24 bytes each).
BLOCK_CHARS = 2_000_000
#: Q-grams that this many items have are not looked up where an item has enough others.
COMMON = 3
#: Bytes of text looked through at once: hits and their sorting take some 100 bytes each.
TEXT_BYTES = 1 << 20
_TABLE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_TWICE = np.uint64(0x9E3779B97F4A7C15 ** 2 % (1 << 64))
_SPACE = ord(" ")


def _fold_table() -> np.ndarray:
    """Small letters one for one, and every white space a blank, for the first 65,536 characters."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        char = chr(c)
        low = char.lower()
        table[c] = _SPACE if char.isspace() else ord(low) if len(low) == 1 else c
    return table


_folds: list[np.ndarray] = []


def folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters in small letters with white space runs as one blank, and the place of each."""
    if not _folds:
        _folds.append(_fold_table())
    out = np.where(codes < 1 << 16, _folds[0][np.minimum(codes, (1 << 16) - 1)], codes)
    blank = out == _SPACE
    keep = np.flatnonzero(~(blank & np.concatenate([[False], blank[:-1]])))
    return out[keep], keep


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of ``Q`` characters."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    two = codes[:-1].astype(np.uint64) * _BASE + codes[1:]
    four = two[:-2] * _BASE_TWICE + two[2:]
    return mix(four[:n] * _BASE_TWICE + two[4:4 + n])


def _slots(keys: np.ndarray) -> np.ndarray:
    """Cells of a table of bits for band keys."""
    return (keys.astype(np.uint64) * _BASE) >> np.uint64(64 - _TABLE_BITS)


def run_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` characters, for sizes below ``Q``."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + codes[i:n + i].astype(np.uint64)
    return mix(out)


@dataclass
class PassageIndex:
    """The q-grams of some benchmark items, and what an item and each passage of a long one
    need of them. Items come first, then passages, those of an item in rising order;
    ``owner`` is the item that an entry belongs to, ``begin`` its first place there."""

    ids: list
    texts: list[np.ndarray]
    owner: np.ndarray
    begin: np.ndarray
    passages: np.ndarray  # of each item, the number of its first passage
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each gram's places
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    asked: np.ndarray  # the least that an item or one of its passages needs
    table: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length below Q: sorted hashes and their items

    @classmethod
    def of(cls, items: list[tuple]) -> PassageIndex:
        ids, texts = [], []
        for item_id, text in items:
            codes = folded(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))[0]
            codes = codes[np.argmax(codes != _SPACE):] if (codes != _SPACE).any() else codes[:0]
            codes = codes[:-1] if len(codes) and codes[-1] == _SPACE else codes
            if len(codes):
                ids.append(item_id)
                texts.append(codes)
        n_items = len(texts)
        owner, begin = list(range(n_items)), [0] * n_items
        for i in range(n_items):
            last = len(texts[i]) - PASSAGE
            for at in [*range(0, last, STEP), last] if last > 0 else []:
                texts.append(texts[i][at:at + PASSAGE])
                owner.append(i)
                begin.append(at)
        owner, begin = np.array(owner, np.int64), np.array(begin, np.int64)
        passages = n_items + np.searchsorted(owner[n_items:], np.arange(n_items + 1))
        hashes = [qgram_hashes(t) for t in texts[:n_items]]
        sizes = np.array([len(h) for h in hashes], np.int64)
        item = np.repeat(np.arange(n_items), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if n_items else np.empty(0, np.int64)
        every = np.concatenate(hashes) if n_items else np.empty(0, np.uint64)
        lengths = np.array([len(t) for t in texts], np.int64)
        edits = np.array([int(n * EDIT_RATE) for n in lengths.tolist()], np.int64)
        first = (np.cumsum(sizes) - sizes)[owner] + begin if n_items else owner
        stop = first + np.maximum(0, lengths - Q + 1)
        # rare q-grams alone are enough where an item or passage has more of them than edits can destroy
        pairs = np.unique(np.stack([every, item.astype(np.uint64)]), axis=1)
        known, items_of = np.unique(pairs[0], return_counts=True)
        rare = items_of[np.searchsorted(known, every)] < COMMON

        def inside(chosen: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(chosen)])
            return upto[stop] - upto[first]

        few = inside(rare) - Q * edits < 8
        edge = np.zeros(len(every) + 1, np.int64)
        np.add.at(edge, first[few], 1)
        np.add.at(edge, stop[few], -1)
        taken = rare | (np.cumsum(edge)[:-1] > 0)
        needed = np.maximum(1, inside(taken) - Q * edits)
        asked = needed[:n_items].copy()
        np.minimum.at(asked, owner, needed)
        every, item, place = every[taken], item[taken], place[taken]
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[grams >> np.uint64(64 - _TABLE_BITS)] = True
        short = {}
        for size in range(1, Q):
            of_size = np.flatnonzero(lengths[:n_items] == size)
            if len(of_size):
                named = np.concatenate([run_hashes(texts[i], size) for i in of_size])
                by_name = np.argsort(named, kind="stable")
                short[size] = named[by_name], of_size[by_name]
        return cls(ids, texts, owner, begin, passages, grams, np.append(first, len(every)), item[order].astype(np.int32), place[order].astype(np.int32), edits, needed, asked, table, short)

    def exact(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Item and place of each occurrence of an item of fewer than ``Q`` characters."""
        for size, (named, items) in self.short.items():
            h = run_hashes(codes, size)
            low, high = np.searchsorted(named, h), np.searchsorted(named, h, side="right")
            for at in np.flatnonzero(high > low).tolist():
                for item in items[low[at]:high[at]].tolist():
                    if (codes[at:at + size] == self.texts[item]).all():
                        yield item, at

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and least diagonal of each band of diagonals with enough shared q-grams."""
        h = qgram_hashes(codes)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        gram = np.searchsorted(self.grams, h[at])
        gram[gram == len(self.grams)] = 0
        same = self.grams[gram] == h[at] if len(self.grams) else np.zeros(0, bool)
        at, gram = at[same], gram[same]
        many = self.first[gram + 1] - self.first[gram]
        posting = np.repeat(self.first[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = self.item[posting].astype(np.int64)
        at, place = np.repeat(at, many), self.place[posting].astype(np.int64)
        keys = self._band_keys(item, at - place)
        named, counts = np.unique(keys, return_counts=True)
        entry = named >> 40
        found = [named[counts >= self.needed[entry]]]
        # what a passage needs lies in one band of its item
        near = named[(counts >= self.asked[entry]) & (self.passages[entry + 1] > self.passages[entry])]
        if len(near):
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[_slots(near)] = True
            maybe = np.flatnonzero(seen[_slots(keys)])
            spot = np.minimum(np.searchsorted(near, keys[maybe]), len(near) - 1)
            hit = np.unique(maybe[near[spot] == keys[maybe]] % len(at))
            found.append(self._passage_bands(item[hit], at[hit], place[hit]))
        keys = np.concatenate(found)
        entry, band = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 20)
        return entry, band * (self.edits[entry] + 1)

    def _band_keys(self, entry: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Both bands of each hit: a band overlaps the next by half, so diagonals up to the
        edits apart share one."""
        band = entry * (1 << 40) + diagonal // (self.edits[entry] + 1) + (1 << 20)
        return np.concatenate([band, band - 1])

    def _passage_bands(self, item: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Keys of the bands of passages with enough of the hits."""
        first, stop = self.passages[item], self.passages[item + 1]
        nth = place // STEP
        # the passages from its own back that may still hold a place, and the last one, out of step
        tried = [first + nth - back for back in range(-(-PASSAGE // STEP))]
        valid = np.stack([*[(e >= first) & (e < stop - 1) for e in tried], np.ones(len(item), bool)])
        entry = np.where(valid, np.stack([*tried, stop - 1]), stop - 1)
        within = place - self.begin[entry]
        valid &= (within >= 0) & (within <= PASSAGE - Q)
        diagonal = at - within
        keys, counts = np.unique(self._band_keys(entry[valid], diagonal[valid]), return_counts=True)
        return keys[counts >= self.needed[keys >> 40]]

    def aligned(self, item: int, text: np.ndarray, least: int) -> tuple[int, int, int] | None:
        """Edits, start and end in ``text`` of the item's best place with its first character
        at ``least`` to ``least`` + 2 (edits + 1), if within its edits."""
        passage, k = self.texts[item], int(self.edits[item])
        span = 2 * (k + 1)
        found = banded(passage, text, least - k, span + 2 * k)
        if found is None or found[0] > k:
            return None
        back = banded(passage[::-1], text[:found[1]][::-1], -k, 2 * k)
        return found[0], found[1] - back[1], found[1]


def banded(passage: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int] | None:
    """Least edits between the passage and a part of the text, and where that part ends, over
    alignments whose diagonals (text place less passage place) lie from ``low`` to ``low + width``."""
    far = 1 << 30
    d = np.arange(low, low + width + 1)
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    steps = np.arange(width + 1)
    padded = np.full(len(passage) + width + 1, 0xFFFFFFFF, np.uint32)
    begin, stop = max(0, low), min(len(text), low + len(padded))
    if stop > begin:
        padded[begin - low:stop - low] = text[begin:stop]
    for i, c in enumerate(passage):
        replaced = cost + (padded[i:i + width + 1] != c)
        dropped = np.append(cost[1:], far) + 1
        cost = np.minimum(replaced, dropped)
        ends = i + 1 + d
        cost[(ends < 0) | (ends > len(text))] = far
        cost = np.minimum.accumulate(cost - steps) + steps
    best = int(cost.argmin())
    return (int(cost[best]), int(len(passage) + d[best])) if cost[best] < far else None


def passages_in(texts: Texts, index: PassageIndex) -> list[tuple[int, int, int, int, int, bool]]:
    """Text, item, start, stop (code points of the text), edits and wholeness of each match."""
    if not len(texts.data) or not index.ids:
        return []
    codes = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    starts, stops = before[texts.starts], before[texts.stops]
    plain, place = folded(codes)
    starts_in, stops_in = np.searchsorted(place, starts), np.searchsorted(place, stops)
    found = set()
    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # whole items, in ``plain``
    known: dict[tuple[int, int], tuple[list[int], list[int]]] | None = None
    for item, at in index.exact(plain):
        size = len(index.texts[item])
        doc = int(np.searchsorted(starts_in, at, side="right")) - 1
        if doc >= 0 and at + size <= stops_in[doc]:
            found.add((doc, item, int(place[at] - starts[doc]), int(place[at + size - 1] + 1 - starts[doc]), 0))
    for item, least in zip(*[x.tolist() for x in index.bands(plain)], strict=True):
        passage, k = index.texts[item], int(index.edits[item])
        low, high = least - k, least + len(passage) + 2 * (k + 1) + k
        for doc in range(max(0, int(np.searchsorted(stops_in, low, side="right"))), int(np.searchsorted(starts_in, high))):
            a, b = max(low, int(starts_in[doc])), min(high, int(stops_in[doc]))
            if b - a < len(passage) - k:
                continue
            if item >= len(index.ids):
                # a place of the passage covers the middle of where it may be; there the whole item lies
                known = _reaches(spans) if known is None else known
                begins, reach = known.get((doc, int(index.owner[item])), ([], []))
                before = bisect_right(begins, (low + high) // 2) - 1
                if before >= 0 and reach[before] > (low + high) // 2:
                    continue
            part = plain[a:b]
            at = part.tobytes().find(passage.tobytes())
            if at >= 0 and at % 4 == 0:
                got = (0, at // 4, at // 4 + len(passage))
            else:
                got = index.aligned(item, part, least - a)
            if got:
                if item < len(index.ids):
                    spans[doc, item].append((a + got[1], a + got[2]))
                first, last = place[a + got[1]], place[a + got[2] - 1] + 1
                found.add((doc, item, int(first - starts[doc]), int(last - starts[doc]), got[0]))
    return sorted(_regions(found, index))


def _reaches(spans: dict[tuple[int, int], list[tuple[int, int]]]) -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """The starts of each list's spans in order, and how far those up to each one reach."""
    out = {}
    for key, some in spans.items():
        some.sort()
        out[key] = [start for start, _ in some], list(accumulate((stop for _, stop in some), max))
    return out


def _regions(found: set[tuple[int, int, int, int, int]], index: PassageIndex) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """Matches of whole items, and what passages of an item cover together away from those."""
    whole, parts = defaultdict(list), defaultdict(list)
    for doc, entry, start, stop, edits in found:
        if entry < len(index.ids):
            whole[doc, entry].append((start, stop))
            yield doc, entry, start, stop, edits, True
        else:
            parts[doc, int(index.owner[entry])].append((start, stop, edits))
    known = _reaches(whole)
    for (doc, item), spans in parts.items():
        begins, reach = known.get((doc, item), ([], []))
        merged: list[list[int]] = []
        for start, stop, edits in sorted(spans):
            before = bisect_left(begins, stop) - 1  # whole ones that begin ahead of its end
            if before >= 0 and reach[before] > start:
                continue
            if merged and start <= merged[-1][1]:
                merged[-1][1:] = max(merged[-1][1], stop), max(merged[-1][2], edits)
            else:
                merged.append([start, stop, edits])
        for start, stop, edits in merged:
            yield doc, item, start, stop, edits, False


def passage_blocks(benchmark: DataFrame, text: str = "text", id_: str = "item_id", chars: int = BLOCK_CHARS) -> Iterator[PassageIndex]:
    """Indexes of the items, at most ``chars`` characters (or one item) at a time."""
    pending, size = [], 0
    for row in benchmark.select(id_, text).toLocalIterator():
        n = len(row[1] or "")
        if pending and size + n > chars:
            yield PassageIndex.of(pending)
            pending, size = [], 0
        pending.append((row[0], row[1]))
        size += n
    if pending:
        yield PassageIndex.of(pending)


def matches_by_block(batches: Iterator[pa.RecordBatch], index: PassageIndex, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """The rows in batches of at most ``TEXT_BYTES`` of text (or one row), each with its matches."""
    for batch in blocks(batches, text, TEXT_BYTES):
        yield batch, passages_in(Texts.of(batch.column(text)), index)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, stop, edits, whole``: each benchmark item found in a document,
    in code points, end exclusive. Clean documents give no row. Where only passages of an item
    are found, what they cover together is a row that is not ``whole``, with the most edits
    of one passage; passages that meet the whole item give no row of their own. Items at one
    place each give a row.

    Case and the amount of white space don't matter, up to ``EDIT_RATE`` edits a character
    are allowed. Null and empty texts hold nothing; repeated rows each give their rows; null
    ids are carried along. Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(id_, text)
    kind = dict(benchmark.dtypes)["item_id"] if "item_id" in benchmark.columns else "long"
    result = schema_with(source, f"item_id {kind}, start long, stop long, edits int, whole boolean", without=text)
    out = spark.createDataFrame([], result)
    for index in passage_blocks(benchmark, chars=chars):
        sent = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, found in matches_by_block(batches, sent.value, text):
                if found:
                    doc, item, start, stop, edits, whole = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_).take(pa.array(doc)), pa.array([sent.value.ids[i] for i in item]), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(edits, pa.int32()), pa.array(whole)],
                        names=[id_, "item_id", "start", "stop", "edits", "whole"],
                    )

        out = out.unionByName(source.mapInArrow(find, result))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold neither a benchmark item nor a passage of one, unchanged."""
    spark = docs.sparkSession
    ship_package(spark)
    for index in passage_blocks(benchmark, chars=chars):
        sent = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, found in matches_by_block(batches, sent.value, text):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in found]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
