"""Stretches of a text that repeat a passage over and over.

A run of period q and at least ``LEAST`` and 2q words agrees with itself q words on, over at
least q and ``LEAST / 2`` words. So every passage of G words in it is met again after at most
q words, for the G of the doubling series LEAST / 2, LEAST, ... with G <= q < 2G (or the
first). Stretches covered by such close repeats are found for a whole Arrow batch at once, by
hashes; they hold every run whole, and what lies outside them holds none. In each stretch the
runs are found by the trees of ``suffixtree``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ship_package
from .frames import dropping, schema_with
from .suffixtree import runs_of
from .text import Texts, Words, blocks, range_hashes

#: Words a run has at least.
LEAST = 12


def stretches(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of each stretch that may hold a run, in rising order."""
    n = len(words.hashes)
    owner = words.owners()
    bound = words.last[owner] if n else np.empty(0, np.int64)
    at = np.arange(n)
    size, lows, highs = max(1, least // 2), [], []
    while True:
        at = at[at + size <= bound[at]]
        if len(at) < 2:
            break
        hashes = range_hashes(words.hashes, at, at + size)
        order = np.argsort(hashes, kind="stable")
        one, two = at[order[:-1]], at[order[1:]]
        again = (hashes[order[:-1]] == hashes[order[1:]]) & (owner[one] == owner[two])
        one, two = one[again], two[again]
        close = two - one < 2 * size if lows else two - one < max(2 * size, least)
        lows.append(one[close])
        highs.append(two[close] + size)
        at = np.unique(np.concatenate([one, two]))
        size *= 2
    low, high = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lows, highs))
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
    # stretches of one text that touch are one; those of two texts never overlap
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] >= high[:-1]) | (owner[low[1:]] != owner[low[:-1]])
    edges = np.flatnonzero(fresh)
    return low[edges], np.append(high[edges[1:] - 1], high[-1:])


def text_runs(words: Words, least: int = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """Text and runs (start in the text, length, period) of each stretch that has any, in rising order."""
    low, high = stretches(words, least)
    texts = np.searchsorted(words.last, low, side="right")
    for i, a, b in zip(texts.tolist(), low.tolist(), high.tolist(), strict=True):
        runs = runs_of(words.hashes[a:b], least)
        if len(runs):
            runs[:, 0] += a - int(words.first[i])
            yield i, runs


def periodic_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """The runs of each text: the input columns but the text, then ``n_words``, ``runs`` (start,
    length and period in words, by start and period), ``longest`` (that of greatest length,
    then smallest start, then period; null without runs) and ``collapsed``: the words that no
    run holds behind its first period, joined by one space.

    Words are runs of characters other than ASCII white space. A run is a stretch of at least
    ``least`` words and twice its smallest period which no neighbouring word continues. A null
    or empty text, and one without words, has no runs and an empty collapsed text. Rows are
    independent: repeated rows and repeated or null ids each give their row, an empty table an
    empty one. Input columns with one of the result's names are replaced. A task needs memory
    in proportion to the longest repetitive stretch of one text.
    """
    ship_package(docs.sparkSession)
    added = ["n_words", "runs", "longest", "collapsed"]
    source = dropping(docs, *added)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            texts = Texts.of(batch.column(text))
            words = texts.words()
            n_words = (words.last - words.first).astype(np.int64)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, runs in text_runs(words, least):
                found[i] += [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
                begin = runs[:, 0] + words.first[i]
                np.add.at(edge, begin + runs[:, 2], 1)
                np.add.at(edge, begin + runs[:, 1], -1)
            best = [min(r, key=lambda x: (-x["length"], x["start"], x["period"])) if r else None for r in found]
            stays = np.cumsum(edge)[:-1] == 0
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(n_words), pa.array(found, pa.list_(run)), pa.array(best, run), joined_words(texts, words, stays)],
                names=[*rest.schema.names, *added],
            )

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return source.mapInArrow(find, schema_with(source, f"n_words long, runs array<{one}>, longest {one}, collapsed string", without=text))


def joined_words(texts: Texts, words: Words, stays: np.ndarray) -> pa.Array:
    """The staying words of each text with one space between them."""
    raw, out = texts.data.tobytes(), []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        keep = np.flatnonzero(stays[a:b]) + a
        out.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.stops[keep].tolist(), strict=True)]).decode())
    return pa.array(out, pa.string())


def planted_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` with a repeated tail in the texts whose id's checksum h ends in 0.

    With n > 0 words and g = h / 10, the words from a = g % n on become that place's first p =
    1 + (n - a) / (3 + g % 8) words over and over; such a text is its words joined by one space.
    Other texts, and those of a null id, stay as they are. Names beginning with ``_planted`` are
    used on the way.
    """
    h = F.crc32(F.col(id_).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column, a: Column, p: Column) -> Column:
        again = F.transform(F.sequence(F.lit(0), F.size(words) - a - 1), lambda i: F.element_at(words, (a + i % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), again), " ")

    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    marked = docs.withColumn("_planted_words", F.when(chosen, words)).withColumn("_planted_n", F.size(F.coalesce("_planted_words", F.array().cast("array<string>"))))
    start = (g % F.col("_planted_n")).cast("int")
    marked = marked.withColumn("_planted_a", F.when(F.col("_planted_n") > 0, start))
    period = (F.lit(1) + F.floor((F.col("_planted_n") - F.col("_planted_a")) / (F.lit(3) + g % 8))).cast("int")
    made = F.when(F.col("_planted_a").isNotNull(), tail(F.col("_planted_words"), F.col("_planted_a"), period)).otherwise(F.col(text))
    return marked.withColumn(text, made).drop("_planted_words", "_planted_n", "_planted_a")
