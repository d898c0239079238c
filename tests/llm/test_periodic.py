"""Runs against a plain look at every period."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlucid.llm.periodic import periodic_runs, planted_repeats, text_runs
from flowlucid.llm.suffixtree import SuffixTree, lyndon_lengths, runs_of
from flowlucid.llm.text import Texts


def plain_runs(words, least):
    """For every period the stretches that agree with themselves, less those of a smaller period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(2, 2 * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, n_, q) for (s, n_), q in found.items() if n_ >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=45), st.sampled_from([2, 3, 12]))
def test_runs_of_short_sequences(words, least):
    assert [tuple(r) for r in runs_of(np.array(words), least).tolist()] == plain_runs(words, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
def test_tree(words):
    n, tree = len(words), SuffixTree(words)
    a, b = np.triu_indices(n + 1, 1)
    for i, j, common in zip(a.tolist(), b.tolist(), tree.common(a, b).tolist(), strict=True):
        k = 0
        while j + k < n and words[i + k] == words[j + k]:
            k += 1
        assert common == k
    for backward in (False, True):
        suffixes = sorted(range(n + 1), key=lambda i: [-w if backward else w for w in words[i:]])
        assert np.argsort(tree.ranks(backward)).tolist() == suffixes
        for i, size in enumerate(lyndon_lengths(tree.ranks(backward)).tolist()):
            order = [-w if backward else w for w in words]
            longest = max(m for m in range(1, n - i + 1) if all(order[i:i + m] < order[i + k:i + m] for k in range(1, m)))
            assert size == longest


def sample(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(["a", "b", "été", "c", *"defghij"], k=rng.randint(0, 30))
            root = rng.choices(["a", "b", "été"], k=rng.randint(1, 25))
            words += (root * 5)[:rng.randint(0, 5 * len(root))]
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    return [None, "", " \n", "a", "a " * 11, "a " * 12, "a " * 3000, *out, *out[:3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stretches_lose_no_run(seed):
    texts = sample(seed)
    words = Texts.of(pa.array(texts)).words()
    got = {}
    for i, runs in text_runs(words):
        got.setdefault(i, []).extend(map(tuple, runs.tolist()))
    assert got == {i: r for i, t in enumerate(texts) if (r := plain_runs((t or "").split(), 12))}


def test_query_against_plain_runs(spark):
    from flowlucid.llm.queries import collapsed_runs

    texts = [*sample(5), " ".join(f"w{i}" for i in range(400)), " ".join(f"x{i % 90}" for i in range(700))]
    rows = [(i * 7, t) for i, t in enumerate(texts * 3)]
    got = {r.doc_id: r for r in collapsed_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import hashlib

    planted = 0
    for doc_id, text in rows:
        words = re.findall("[^ \t-\r]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs, r = plain_runs(words, 12), got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
    assert planted > 10


def test_edges(spark):
    unit = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None, 1), (2, "", 2), (None, f"{unit} " * 3, 3), (None, f"{unit} " * 3, 3), (4, "x " * 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs int")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    again = ("None", 27, [(0, 27, 9)], unit)
    assert got == [("1", 0, [], ""), ("2", 0, [], ""), ("4", 200_000, [(0, 200_000, 1)], "x"), again, again]
    assert periodic_runs(docs.limit(0)).count() == 0
    assert planted_repeats(docs.select("doc_id", "text")).filter("doc_id is null").select("text").distinct().collect()[0][0] == f"{unit} " * 3
