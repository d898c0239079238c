"""Importance weights against a plain count, and the sample against its labels."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlucid.llm import quality
from flowlucid.llm.order import kth_largest
from flowlucid.llm.quality import BUCKET_BITS, LENGTH, SHRINK, fit_importance, labelled_cut, ngram_buckets, resample
from flowlucid.llm.queries import op5_quality_resampling
from flowlucid.llm.text import Texts

MIDDLE = "/root/testdata/sf0.01"


def buckets(text):
    return ngram_buckets(Texts.of(pa.array([text])))[0].tolist()


def test_weights_against_plain_count(spark):
    texts = ["a b c a b", "good words here", None, "", "JUNK JUNK JUNK!!", "good words there été"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = fit_importance(docs, [1, 5])
    raw, target = ({}, {})
    for i, t in enumerate(texts):
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            if i in (1, 5):
                target[b] = target.get(b, 0) + 1
    size = 1 << BUCKET_BITS
    p = {b: math.log((target.get(b, 0) + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in raw}
    got = model.weights(Texts.of(pa.array(texts)))
    for t, w in zip(texts, got, strict=True):
        assert w == pytest.approx(LENGTH * sum(p[b] for b in buckets(t)) / (len(buckets(t)) + SHRINK))


def test_cut():
    assert labelled_cut(np.array([1.0, 2, 3]), np.array([-5.0, -4])) == -1.5
    assert labelled_cut(np.array([1.0]), np.array([])) is None


@pytest.mark.parametrize("k", [1, 5000, 19_999, 30_000])
def test_kth_largest(spark, k):
    frame = spark.range(30_000).select((F.col("id") % 20_000 * 7919 % 20_011).alias("v"))
    assert kth_largest(frame, "v", k) == sorted((i % 20_000 * 7919 % 20_011 for i in range(30_000)), reverse=True)[k - 1]


def test_kth_largest_odd(spark):
    assert kth_largest(spark.range(20_000).select(F.lit(3.5).alias("v")), "v", 17) == 3.5
    assert kth_largest(spark.range(3), "id", 4) is None


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = resample(docs, labels.filter(fold)).join(labels.filter(~fold), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.05


def test_query_and_sample_size(spark):
    found = op5_quality_resampling(spark, MIDDLE)
    assert found.count() == 1000
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    assert resample(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"), k=100).filter("kept").count() == 100


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words", None), (3, "good " * 50_000, "y"), (3, "good " * 50_000, "y"), (4, "B@D B@D B@D", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    got = resample(docs, labels).collect()
    assert len(got) == 6 and all(r.kept for r in got if r.doc_id == 3) and not any(r.kept for r in got if r.doc_id == 4)
    assert {r.log_weight for r in got if r.doc_id in (1, 2)} == {0.0}
    assert resample(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in resample(docs, labels.limit(0)).collect())


def test_memory_is_bounded_by_blocks_of_text():
    """N-grams of a large batch of texts are not held at once; weights are those of each text alone."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "bc", "def", "ghij"], k=rng.randint(0, 1200))) for _ in range(2200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    model = quality.ImportanceModel(np.random.default_rng(1).normal(size=1 << BUCKET_BITS))
    model.weights(Texts.of(pa.array(texts[:1])))  # tables of powers are made once
    tracemalloc.start()
    got = [w for _, some in quality.texts_by_block(iter([batch])) for w in model.weights(some)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 4 << 20 and peak < 150 << 20, peak
    assert [got[i] for i in (0, 700, 2199)] == [model.weights(Texts.of(pa.array([texts[i]])))[0] for i in (0, 700, 2199)]
