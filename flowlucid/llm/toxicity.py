"""Toxicity grades by cumulative-link ordinal regression.

One weight vector over hashed words serves all ordered thresholds: P(grade <= g | x) is
the logistic function of threshold g less w x. The expected severity is the sum over
thresholds of the probability of lying above. Words are chosen and weights fitted on a
bounded sample of labelled documents; every document is scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ship_package, small_table
from .frames import dropping, schema_with
from .quality import labelled_sample
from .text import LOWER, SIGNS, VALUES, Texts, blocks, mix, range_hashes

BUCKET_BITS = 18
#: Bytes of the word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5)
#: Labelled documents of each kind that are fitted on, at most, in hash order.
LABELLED = 5_000
#: Grades of toxic documents, mild to severe; 0 is not toxic.
TOXIC_GRADES = 3
#: Standard scores by which a word's share among toxic documents must differ.
EVIDENT = 4.0
#: Least share of either kind's documents that hold a chosen word; what only copies of a few
#: documents share is none.
LEAST_SHARE = 0.02
#: Times that the larger share must be the smaller one.
LIFT = 4.0
RIDGE, STEPS, RATE = 1e-4, 800, 0.05


def word_counts(texts: Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and count of each distinct word and word beginning, or of those in wanted buckets."""
    words = texts.words(lower=True, between=SIGNS)
    hashes, owner = [words.hashes], [words.owners()]
    values = VALUES[0][LOWER[texts.data]]
    for size in BEGINNINGS:
        longer = words.stops - words.starts > size
        start = words.starts[longer]
        hashes.append(mix(range_hashes(values, start, start + size) + np.uint64(size)))
        owner.append(owner[0][longer])
    bucket, owner = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(owner)
    if wanted is not None:
        some = wanted[bucket]
        bucket, owner = bucket[some], owner[some]
    pairs, counts = np.unique(owner << BUCKET_BITS | bucket, return_counts=True)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1), counts


def strengths(counts: np.ndarray) -> np.ndarray:
    """What a word's count in a text weighs: one, and little more for more."""
    return 1 + np.log(counts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class OrdinalModel:
    """Weights by bucket and rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: Texts) -> np.ndarray:
        """For each text the probabilities of lying above each threshold."""
        doc, bucket, count = word_counts(texts, self.weights != 0)
        score = np.bincount(doc, weights=self.weights[bucket] * strengths(count), minlength=len(texts.starts))
        return _logistic(score[:, None] - self.thresholds)


def evident_buckets(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share of documents differs between the kinds, and the standard scores."""
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    has = np.stack([np.bincount(bucket[toxic[doc] == v], minlength=1 << BUCKET_BITS) for v in (False, True)])
    share, whole = has / np.maximum(n, 1)[:, None], has.sum(0) / max(n.sum(), 1)
    spread = np.sqrt(np.maximum(whole * (1 - whole), 1e-12) * (1 / np.maximum(n, 1)).sum())
    z = (share[1] - share[0]) / spread
    apart = share.max(0) >= LIFT * share.min(0)
    chosen = np.flatnonzero((np.abs(z) >= EVIDENT) & apart & (share.max(0) >= LEAST_SHARE) & (has.sum(0) >= 3))
    return chosen, z[chosen]


def fit_ordinal(doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, grades: int, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the ridge-penalised likelihood, by adaptive gradient steps.

    Entries ``(doc, column, value)`` are the sparse features; ``grade`` is 0 to ``grades - 1``
    and ``share`` what each document counts, in all one (if not given, all alike).
    """
    n = len(grade)
    share = np.full(n, 1 / n) if share is None else share
    w, first, gaps = np.zeros(columns), np.zeros(1), np.zeros(grades - 2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, gaps)]
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([first, np.exp(gaps)]))
        score = np.bincount(doc, weights=w[column] * value, minlength=n)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = (_logistic(bounds[grade + k] - score) for k in (1, 0))
        upper[grade == grades - 1], lower[grade == 0] = 1, 0
        p = np.maximum(upper - lower, 1e-12)
        du, dl = share * upper * (1 - upper) / p, share * lower * (1 - lower) / p
        d_theta = np.array([dl[grade == k + 1].sum() - du[grade == k].sum() for k in range(grades - 1)])
        d_score = du - dl
        tail = np.cumsum(d_theta[::-1])[::-1]
        slopes = (np.bincount(column, weights=d_score[doc] * value, minlength=columns) + RIDGE * w, tail[:1], tail[1:] * np.exp(gaps))
        for p_, g, (m, v) in zip((w, first, gaps), slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w, np.cumsum(np.concatenate([first, np.exp(gaps)]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, text: str = "text", id_: str = "doc_id") -> OrdinalModel | None:
    """The model from up to ``bound`` toxic and as many other labelled documents.

    Labels know only toxic or not; toxic ones get a grade by how much evidently toxic
    vocabulary they hold, in equal parts. None without labels of both kinds.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ids = {v: labelled_sample(labels, "toxic", v, bound, id_) for v in (0, 1)}
    ids[0] = sorted(set(ids[0]) - set(ids[1]))
    known = F.broadcast(small_table(spark, [(i, v) for v in ids for i in ids[v]], "known_id long, known int"))
    source = docs.select(id_, text).join(known, docs[id_] == known["known_id"]).select(text, "known")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            doc, bucket, n = word_counts(Texts.of(batch.column(text)))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (bucket, n)]
            yield pa.RecordBatch.from_arrays([batch.column("known"), *lists], names=["known", "buckets", "counts"])

    got = source.mapInArrow(count, "known int, buckets array<int>, counts array<int>").toArrow().combine_chunks()
    toxic = got.column("known").to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    sizes = pa.compute.list_value_length(got.column("buckets")).to_numpy()
    doc = np.repeat(np.arange(len(toxic)), sizes)
    bucket, n = (pa.compute.list_flatten(got.column(c)).to_numpy().astype(np.int64) for c in ("buckets", "counts"))
    chosen, z = evident_buckets(doc, bucket, toxic)
    column = np.full(1 << BUCKET_BITS, -1)
    column[chosen] = np.arange(len(chosen))
    some = column[bucket] >= 0
    doc, column, value = doc[some], column[bucket[some]], strengths(n[some])
    strength = np.bincount(doc, weights=np.where(z[column] > 0, value, 0), minlength=len(toxic)) / np.log1p(np.maximum(sizes, 1))
    grade = np.zeros(len(toxic), np.int64)
    grade[toxic] = 1 + np.minimum(np.argsort(np.argsort(strength[toxic], kind="stable"), kind="stable") * TOXIC_GRADES // toxic.sum(), TOXIC_GRADES - 1)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())  # both kinds count the same
    w, thresholds = fit_ordinal(doc, column, value, grade, len(chosen), TOXIC_GRADES + 1, share)
    weights = np.zeros(1 << BUCKET_BITS)
    weights[chosen] = w
    return OrdinalModel(weights, thresholds)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The input columns but the text, then ``expected_severity`` (0 to ``TOXIC_GRADES``),
    ``grade`` (the likeliest) and ``toxic`` (more likely than not).

    A null or empty text has no toxic words. Without labels of both kinds nothing is known,
    and all three are null. Repeated rows and null ids each give their row; no rows give none.
    """
    source = dropping(docs, "expected_severity", "grade", "toxic")
    model = fit_toxicity(source, labels, bound, text, id_)
    if model is None:
        return source.drop(text).withColumns({"expected_severity": F.lit(None).cast("double"), "grade": F.lit(None).cast("int"), "toxic": F.lit(None).cast("boolean")})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            above = sent.value.above(Texts.of(batch.column(text)))
            each = np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(above.sum(1)), pa.array((-each).argmax(1).astype(np.int32)), pa.array(above[:, 0] > 0.5)],
                names=[*rest.schema.names, "expected_severity", "grade", "toxic"],
            )

    return source.mapInArrow(score, schema_with(source, "expected_severity double, grade int, toxic boolean", without=text))
