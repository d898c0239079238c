"""Removed passages against a plain count of all windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlucid.llm import repeats
from flowlucid.llm.jaccard import one_of_each
from flowlucid.llm.prefixfree import without_repeated_bytes
from flowlucid.llm.repeats import anchored_windows, combined, without_repeats
from flowlucid.llm.sketch import count_sketch, may_have
from flowlucid.llm.text import Texts, mix


def plain(texts, width):
    words = [re.findall("[^ \t-\r]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def sample(seed, n=120):
    rng = random.Random(seed)
    words = ["été", "a", "of", "straße", *(f"w{i}" for i in range(40))]
    parts = [" ".join(rng.choices(words, k=rng.randint(20, 90))) for _ in range(10)]
    texts = [rng.choice([" ", "\n", " \t"]).join([" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(parts), " ".join(rng.choices(words, k=rng.randint(0, 30)))]) for _ in range(n)]
    return texts + texts[:5] + [None, "", "  ", "a", "a " * 500, "x" * 5000, parts[0]]


@pytest.mark.parametrize("width", [35, 12, 5])
def test_against_plain_count(spark, width):
    texts = sample(width)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, width).collect()}
    assert got == dict(enumerate(plain(texts, width)))


def test_repeated_ids_nulls_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1, "x"), (None, "only here", 2, "y"), (7, text, 3, None), (7, text, 3, None), (7, "short", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, kept string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in without_repeats(docs).collect())
    assert got == [("7", 1, 0), ("7", 50, 50), ("7", 50, 50), ("None", 2, 0), ("None", 50, 50)]
    assert without_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_whose_short_hashes_agree(spark):
    """Two texts without a common word, of equal 32-bit hash and null id; one has a copy elsewhere."""
    words = "concat_ws(' ', transform(sequence(1, 40), j -> concat('w', id, 'x', j)))"
    texts = spark.range(250_000).selectExpr("id", f"{words} AS text").withColumn("h", F.hash("text"))
    a, b = texts.groupBy("h").agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t[:2]
    docs = spark.createDataFrame([(None, a), (None, b), (7, a), (None, a), (None, a)], "doc_id long, text string")
    kept = sorted((r.n_words, r.n_removed) for r in without_repeats(docs).collect())
    assert kept == [(40, 0)] + [(40, 40)] * 4
    assert sorted(bytes(r.kept).decode() for r in without_repeated_bytes(docs).collect()) == [""] * 4 + [b]
    assert sorted(r.text for r in one_of_each(docs).collect()) == sorted([a, b])


def test_combined_keeps_every_fingerprint():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 30, 200).astype(np.uint64)
    second = first * np.uint64(3) + (rng.random(200) < 0.1).astype(np.uint64)
    k1, k2, n = combined(first, second)
    total = defaultdict(int)
    for a, b, c in zip(k1.tolist(), k2.tolist(), n.tolist(), strict=True):
        total[a, b] += c
    true = Counter(zip(first.tolist(), second.tolist(), strict=True))
    for a, b, x, y in zip(first.tolist(), second.tolist(), k1.tolist(), k2.tolist(), strict=True):
        assert (total[x, y] >= 2) == (true[a, b] >= 2)


def test_sketch_never_misses(spark):
    rows = [(i,) for i in [*range(3000), *range(0, 3000, 7)]]
    frame = spark.createDataFrame(rows, "v long").repartition(5)

    def hashes(batches):
        for b in batches:
            yield b.column("v").to_numpy().astype(np.uint64)

    for depth in (1, 2):
        sketch = count_sketch(frame, hashes, 20, depth, 2)
        yes = may_have(sketch, np.arange(3000, dtype=np.uint64), 20, depth)
        assert yes[::7].all() and yes.mean() < 0.2
        assert may_have(count_sketch(frame, hashes, 20, depth, 1), np.arange(3000, dtype=np.uint64), 20, depth).all()


@pytest.mark.parametrize("width", [35, 12, 5])
def test_anchors_of_texts_longer_than_a_place(monkeypatch, width):
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 7) - 1))
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(60)]
    words = [f"a{rng.random()}" for _ in range(1000)] + passage + [f"b{rng.random()}" for _ in range(777)] + passage
    found = Texts.of(pa.array([" ".join(words)])).words()
    starts, places, runs = anchored_windows(found, width)
    assert starts.tolist() == list(range(len(words) - width + 1))
    short = min(repeats.ANCHOR_WORDS, width)
    assert ((places >= starts) & (places <= starts + width - short)).all()
    # equal windows, equal anchors
    assert (runs[places[1000:1000 + 60 - width + 1]] == runs[places[-(60 - width + 1):]]).all()


def test_own_keys_of_unlike_blocks_do_not_meet():
    """Places known to repeat in their block are no group across blocks."""
    rng = np.random.default_rng(3)
    keys = []
    for _ in range(20):
        first = rng.integers(0, 1 << 63, 50, dtype=np.uint64).repeat(3)
        k1, k2, n = combined(first, mix(first), apart=True)
        known = k2 == 0
        assert known.sum() == 100 and (n == 2).all()
        assert (np.sort(k1[~known]) == np.sort(first[::3])).all()
        keys += k1[known].tolist()
    assert len(set(keys)) == len(keys)
