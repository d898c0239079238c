"""Removed byte strings against a plain count of all strings."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlucid.llm.prefixfree import Parse, trigger_places, without_repeated_bytes
from flowlucid.llm.text import VALUES, Texts, hashes_between, range_hashes, running_sums


def plain(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def sample(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é ü\n"
    def text(n):
        return "".join(rng.choices(letters, k=n))
    parts = [text(rng.randint(30, 400)) for _ in range(12)]
    texts = []
    for _ in range(90):
        t = text(rng.randint(0, 150)) + rng.choice(parts) + text(rng.randint(0, 150))
        if rng.random() < 0.4:  # a near copy
            k = rng.randrange(len(t))
            texts.append(t[:k] + "#" + t[k + 1:])
        texts.append(t)
    return texts + texts[:4] + [None, "", "a", "b" * 900, "ab" * 300, parts[0], parts[1] * 3]


@pytest.mark.parametrize(("width", "phrase"), [(200, 24), (60, 12), (40, 40), (9, 4)])
def test_against_plain_count(spark, width, phrase):
    texts = sample(width)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeated_bytes(docs, width, phrase).collect()}
    assert got == dict(enumerate(plain(texts, width)))


def test_repeated_ids_nulls_and_clashing_names(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(100))
    rows = [(None, text, 1, "x"), (None, "only here", 2, "y"), (7, text, 3, None), (7, text, 3, None), (7, "short", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, kept string")
    got = sorted((str(r.doc_id), r.n_bytes == r.n_removed, r.n_spans) for r in without_repeated_bytes(docs).collect())
    assert got == [("7", False, 0), ("7", True, 1), ("7", True, 1), ("None", False, 0), ("None", True, 1)]
    assert without_repeated_bytes(docs.limit(0)).count() == 0


def test_triggers_depend_on_content_only():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    shifted = np.concatenate([rng.integers(0, 256, 13).astype(np.uint8), data])
    there = trigger_places(shifted, 24) - 13
    assert trigger_places(data, 24).tolist() == there[there >= 0].tolist()


@pytest.mark.parametrize(("width", "phrase"), [(60, 12), (40, 40), (9, 4)])
def test_open_blocks_hold_the_strings_without_a_phrase_found_once(width, phrase):
    texts = Texts.of(pa.array(sample(width), pa.string()))
    p = Parse.of(texts, width, phrase)
    repeats = np.random.default_rng(width).random(len(p.phrase_from)) < 0.8
    once = [(p.triggers[i], p.triggers[i + 1] + 8) for i in p.phrase_from[~repeats]]
    found = {i for a, b in zip(texts.starts, texts.stops) for i in range(a, b - width + 1)}
    for a, b in once:
        found -= set(range(b - width, a + 1))
    start, upto, first, past = p.open_blocks(repeats)
    assert {i for a, b in zip(first, past) for i in range(a, b)} == found
    assert len(found) == (past - first).sum() and (start <= first).all() and (past <= upto).all()


def test_a_parse_makes_no_list_for_each_byte_but_the_sums():
    """Time and memory went into a dozen arrays as long as the text in each of five passes."""
    data = np.random.default_rng(0).integers(97, 123, 1 << 20).astype(np.uint8)
    texts = Texts(data, np.arange(0, len(data), 1 << 12), np.arange(1 << 12, len(data) + 1, 1 << 12))
    Parse.of(texts, 200, 16).phrase_hashes()  # tables of powers are made once
    tracemalloc.start()
    p = Parse.of(texts, 200, 16)
    p.open_blocks(np.random.default_rng(1).random(len(p.phrase_hashes())) < 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)


def test_hashes_from_sums_are_those_of_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 100_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 99_000, 500))
    stops = starts + rng.integers(0, 1000, 500)
    assert (hashes_between(running_sums(data, VALUES[0]), starts, stops) == range_hashes(data, starts, stops, VALUES[0])).all()
