"""The ordinal model against its likelihood and held-out labels."""

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlucid.llm import toxicity as module
from flowlucid.llm.queries import op3_toxicity
from flowlucid.llm.text import Texts
from flowlucid.llm.toxicity import RIDGE, fit_ordinal, fit_toxicity, toxicity, word_counts

LARGE = "/root/testdata/sf0.1"


def loss(w, theta, x, grade):
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    s = x @ w
    f = lambda t: 1 / (1 + np.exp(-(t - s)))
    return -np.log(np.maximum(f(edges[grade + 1]) - f(edges[grade]), 1e-12)).mean() + RIDGE / 2 * (w ** 2).sum()


def test_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    grade = np.digitize(x @ [1.5, -1, 0] + rng.logistic(size=400), [-1, 0.5, 2])
    doc, column = np.nonzero(np.ones_like(x))
    w, theta = fit_ordinal(doc, column, x.ravel(), grade, 3, 4)
    assert (np.diff(theta) > 0).all()
    base = loss(w, theta, x, grade)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, theta, x, grade) > base - 1e-5
            moved = theta.copy()
            moved[i] += step
            assert loss(w, moved, x, grade) > base - 1e-5


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = toxicity(docs, labels.filter(fold)).withColumnRenamed("toxic", "found").join(labels.filter(~fold), "doc_id").collect()
    hit = [r.found for r in rows if r.toxic == 1]
    other = [r.found for r in rows if r.toxic == 0]
    assert np.mean(hit) >= 0.92 and np.mean(other) <= 0.04
    assert {r.grade for r in rows if r.found} == {1, 2, 3}


def test_query_and_edge_rows(spark):
    assert op3_toxicity(spark, "/root/testdata/sf0.01").count() == 1000
    rows = [(1, None, "a"), (2, "", "b"), (None, "bad words", None), (3, "bad " * 100_000, "c"), (3, "bad bad", "c"), (4, "fine", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 6 and all(r.expected_severity is not None for r in got)
    assert toxicity(docs.limit(0), labels).count() == 0
    assert all(r.toxic is None for r in toxicity(docs, labels.limit(0)).collect())


@cache
def features(word):
    """Buckets of a word and its beginnings."""
    _, bucket, count = word_counts(Texts.of(pa.array([word])))
    return Counter(dict(zip(bucket.tolist(), count.tolist(), strict=True)))


def test_query_against_plain_scores(spark, monkeypatch):
    """Every document scored word by word with the fitted weights."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(module, "fit_toxicity", lambda *_: model)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op3_toxicity(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        lower = re.sub("[A-Z]+", lambda m: m.group().lower(), texts[r.doc_id])
        counts = Counter()
        for word, n in Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)).items():
            for bucket, m in features(word).items():
                counts[bucket] += n * m
        score = sum(model.weights[b] * (1 + math.log(n)) for b, n in counts.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(above), abs=2e-6)
        assert r.toxic == (above[0] > 0.5)
        each = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert each[r.grade] == pytest.approx(max(each), abs=1e-9)


def test_columns_that_clash_in_another_case(spark):
    docs = spark.createDataFrame([(1, "fine words", "a", 7, True), (2, None, "b", 8, None)], "doc_id long, text string, Grade string, EXPECTED_severity int, Toxic boolean")
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "doc_id long, toxic int, text string")
    got = toxicity(docs, labels)
    assert got.columns == ["doc_id", "expected_severity", "grade", "toxic"] and got.count() == 2
