"""Components of similar documents against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlucid import config
from flowlucid.llm import graph
from flowlucid.llm.graph import components
from flowlucid.llm.jaccard import batch_sets, bitmap, linked, ngram_sets, similar_enough, with_components
from flowlucid.llm.text import Texts

from ..conftest import SMALL


def plain(rows, n=4):
    sets = []
    for _, t in rows:
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {d: d for d, _ in rows}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets)}


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=25))
    rows, bases = [], [rng.choices(words, k=rng.randint(10, 200)) for _ in range(15)]
    for d in range(n):
        base = list(rng.choice(bases)) if d % 3 else rng.choices(words, k=rng.randint(1, 80))
        for _ in range(rng.randint(0, 5)):
            base[rng.randrange(len(base))] = rng.choice(words)
        text = " ".join(base)
        rows.append((d * 3 + 1, (text.upper() if d % 7 == 0 else text) + ("\n" + line if d % 2 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = near_copies(seed, 250) + [(2, None), (5, ""), (8, " \n"), (11, "one two"), (14, "One  TWO"), (17, "É one"), (20, "é one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in with_components(docs).collect()} == plain(rows)


def test_query_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in with_components(docs).collect()} == plain(rows)


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(3, long, "x", 1), (2, long + " z", "x", 1), (None, "a b c d e", None, 2), (9, "a b c d e", "y", 3), (9, "a b c d e", "y", 3), (None, "alone", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, n_shingles int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in with_components(docs).collect())
    assert got == [("2", 59_998, "2"), ("3", 59_997, "2"), ("9", 2, "9"), ("9", 2, "9"), ("None", 1, "None"), ("None", 2, "9")]
    assert with_components(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=60))
def test_tree_equals_all_pairs(sets):
    members = [np.sort(np.array(list(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    got = linked(np.array([len(m) for m in members]), [bitmap(m) for m in members], lambda i, j: similar_enough(members[i], members[j]))
    up = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low, high = sorted((up[i], up[j]))
                    up = [low if u == high else u for u in up]
                    changed = True
    assert got == up


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(500):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert found == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_have_few_files(spark, tmp_path, monkeypatch):
    """Also where shuffles have many partitions, which are not joined by size."""
    monkeypatch.setattr(config, "scratch_root", lambda spark, root=None: str(tmp_path))
    settings_ = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    kept = []
    monkeypatch.setattr(graph, "remove_path", lambda spark, path: kept.append(path))
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        edges = spark.range(600).selectExpr("id * 2 as a", "id * 2 + 1 as b")
        got = {r.node: r.component for r in components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: n // 2 * 2 for n in range(1200)}
    files = [len(list(d.glob("part-*"))) for d in tmp_path.iterdir() if d.is_dir()]
    assert kept and len(files) > len(kept) and max(files) <= 32, files


def test_memory_is_bounded_by_blocks_of_text():
    """What the sets of a large batch are made from is not held at once; they are those of each text alone."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "bc", "def", "ghij", "klmno"], k=rng.randint(0, 1500))) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None]})
    ngram_sets(Texts.of(pa.array(texts[:1])), 4)  # tables of powers are made once
    tracemalloc.start()
    got = batch_sets(batch, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 4 << 20 and peak < 45 << 20, peak
    assert len(got) == len(texts) + 1 and not len(got[-1])
    assert all(np.array_equal(got[i], ngram_sets(Texts.of(pa.array([t])), 4)[0]) for i, t in enumerate(texts))
