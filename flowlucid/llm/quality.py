"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good) and one of
all raw text, give each document its importance: the log ratio of its likelihoods. A
sample is drawn without replacement by Gumbel top-k: add Gumbel noise to the log weights
and keep the k largest. N-grams are of words and of word shapes (kinds of first and last
characters, length, whether it repeats the word before).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import scratch_dir, ship_package, small_table
from .frames import dropping, schema_with
from .order import kth_largest
from .text import Texts, blocks, mix

BUCKET_BITS = 16
#: Labelled documents of each kind that the target model and the sample size are fitted on, at most.
LABELLED = 20_000
#: Likelihoods are those of a text of this many n-grams with the document's mean, so that
#: length alone neither selects nor rejects; short texts lean to a ratio of one.
LENGTH = 200
SHRINK = 50
#: Bytes of text looked through at once: n-grams and what they are made of take some 50 times as many.
TEXT_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

_KIND = np.array([
    1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 + c % 11 for c in range(256)
], dtype=np.uint64)


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of each n-gram."""
    words = texts.words()
    owner, h, data = words.owners(), words.hashes, texts.data
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = owner[:-1] == owner[1:]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & same]).astype(np.uint64)
    last = words.stops - 1
    before_last = np.maximum(words.stops - 2, words.starts)
    size = np.minimum(words.stops - words.starts, 15).astype(np.uint64) >> np.uint64(2)
    parts = [_KIND[data[words.starts]], _KIND[data[before_last]], _KIND[data[last]], size, again]
    shape = np.zeros(len(h), np.uint64)
    for p in parts:
        shape = shape * np.uint64(32) + p
    shape = mix(shape)
    grams = [h, shape, *[mix(x[:-1] * _STEP + x[1:] + np.uint64(i))[same] for i, x in enumerate((h, shape))]]
    pairs = owner[:-1][same]
    return (np.concatenate(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([owner, owner, pairs, pairs])


def texts_by_block(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows in batches of at most ``TEXT_BYTES`` of text (or one row), each with its texts."""
    for batch in blocks(batches, text, TEXT_BYTES):
        yield batch, Texts.of(batch.column(text))


@dataclass
class ImportanceModel:
    """Log ratio of target and raw probability of each bucket."""

    ratios: np.ndarray

    def weights(self, texts: Texts) -> np.ndarray:
        bucket, owner = ngram_buckets(texts)
        total = np.bincount(owner, weights=self.ratios[bucket], minlength=len(texts.starts))
        return LENGTH * total / (np.bincount(owner, minlength=len(texts.starts)) + SHRINK)


def labelled_sample(labels: DataFrame, label: str, value: int, bound: int, id_: str = "doc_id") -> list[int]:
    """Ids with that label, the first ``bound`` in hash order; each once."""
    ids = labels.filter((F.col(label) == value) & F.col(id_).isNotNull()).select(id_).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64(F.lit("sample"), id_), id_).limit(bound).collect()]


def fit_importance(docs: DataFrame, target_ids: list[int], text: str = "text", id_: str = "doc_id") -> ImportanceModel:
    """Counts over all documents and over the target ones, in one pass. Without target
    documents all ratios are zero."""
    spark = docs.sparkSession
    ship_package(spark)
    targets = F.broadcast(small_table(spark, [(i,) for i in target_ids], "target_id long"))
    source = docs.select(text, id_).join(targets, docs[id_] == targets["target_id"], "left").select(text, F.col("target_id").isNotNull().alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch, texts in texts_by_block(batches, text):
            bucket, owner = ngram_buckets(texts)
            raw += np.bincount(bucket, minlength=len(raw))
            good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)[owner]
            target += np.bincount(bucket[good], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = source.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for bucket, n, m in counted.collect():  # a row for each bucket, whatever the data
        raw[bucket], target[bucket] = n, m
    if not target.any():
        return ImportanceModel(np.zeros(1 << BUCKET_BITS))
    share = [np.log((x + 1) / (x.sum() + len(x))) for x in (target, raw)]
    return ImportanceModel(share[0] - share[1])


def with_log_weight(docs: DataFrame, model: ImportanceModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``log_weight``."""
    source = dropping(docs, "log_weight")
    ratios = docs.sparkSession.sparkContext.broadcast(model.ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_by_block(batches, text):
            weight = ImportanceModel(ratios.value).weights(texts)
            yield batch.append_column("log_weight", pa.array(weight))

    return source.mapInArrow(score, schema_with(source, "log_weight double"))


def gumbel(id_: str, text: str) -> Column:
    """Gumbel noise that a row always gets again."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), id_, text), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def labelled_cut(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The log weight that tells labelled documents apart with the least sum of error rates,
    in the middle of the gap where it is best; None without labels of both kinds."""
    if not len(good) or not len(bad):
        return None
    edges = np.unique(np.concatenate([good, bad]))
    middles = (edges[1:] + edges[:-1]) / 2
    if not len(middles):
        return None
    errors = np.searchsorted(np.sort(good), middles) / len(good) + 1 - np.searchsorted(np.sort(bad), middles) / len(bad)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    widest = best[np.argmax((edges[1:] - edges[:-1])[best])]
    return float(middles[widest])


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, bound: int = LABELLED, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` plus ``log_weight`` and ``kept``, true for a Gumbel top-k sample.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1). ``k`` is the sample's size; if not
    given, it is the number of documents whose weight lies above the cut that best tells up
    to ``bound`` labelled good from as many bad ones. Without labels of both kinds all are
    kept. Rows that tie at the last place are kept together. Null and empty texts have a
    weight of zero; repeated rows share weight and noise. No rows give no rows.
    """
    spark = docs.sparkSession
    source = dropping(docs, "log_weight", "kept", "gumbel_key", "known_id", "known")
    good, bad = (labelled_sample(labels, "quality", v, bound) for v in (1, 0))
    bad = sorted(set(bad) - set(good))
    model = fit_importance(source, good, text, id_)
    noise = F.col("log_weight") + gumbel(id_, text)
    # the numbers of all documents, small beside the texts, are stored once
    path = scratch_dir(spark, "weights")
    known = F.broadcast(small_table(spark, [(i, 1) for i in good] + [(i, 0) for i in bad], "known_id long, known int"))
    met = source.select(id_, text).join(known, source[id_] == known["known_id"], "left")
    with_log_weight(met, model, text).select("known", "log_weight", noise.alias("gumbel_key")).write.parquet(path)
    weights = spark.read.parquet(path)
    if k is None:
        pairs = weights.filter("known is not null").select("known", "log_weight").toPandas()
        cut = labelled_cut(*[pairs.log_weight[pairs.known == v].to_numpy() for v in (1, 0)])
        k = weights.count() if cut is None else weights.filter(F.col("log_weight") >= cut).count()
    least = kth_largest(weights, "gumbel_key", k)
    kept = F.lit(k > 0) if least is None else noise >= least
    return with_log_weight(source, model, text).withColumn("kept", kept)
