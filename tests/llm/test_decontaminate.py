"""Benchmark passages against a plain alignment of every item with every text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlucid.llm import decontaminate
from flowlucid.llm.decontaminate import EDIT_RATE, PASSAGE, STEP, PassageIndex, banded, contamination, decontaminated, passages_in
from flowlucid.llm.queries import op1_benchmark_decontamination
from flowlucid.llm.text import Texts


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def least_edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=20))
def test_wide_band_equals_plain_alignment(passage, text):
    got = banded(codes(passage), codes(text), -len(passage), len(passage) + len(text))
    assert got[0] == least_edits(passage, text)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i:i + 1] = rng.choice([[], ["#"], [chars[i], "%"]])
    return "".join(chars)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mé", "ni", "straße", "日") for b in ("ta", "r", "so", "n", "be")]
    def text(n):
        return " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(15, 45))) for i in range(30)] + [(100, None), (101, "short one"), (102, "")]
    docs, planted = [], set()
    for d in range(120):
        body = text(rng.randint(0, 80))
        if d % 4 == 0:
            i, passage = items[rng.randrange(30)]
            k = int(len(passage.lower()) * EDIT_RATE) if d % 8 else 0
            passage = edited(rng, passage, k).replace(" ", rng.choice([" ", "\n ", "  "]))
            body = f"{body} {passage.upper() if d % 3 == 0 and 'ß' not in passage else passage} {text(5)}"
            planted.add((d, i))
        docs.append((d, body))
    return docs, items, planted


@pytest.mark.parametrize(("seed", "chars"), [(1, 2_000_000), (2, 900)])
def test_planted_passages(spark, seed, chars):
    docs, items, planted = corpus(seed)
    frame = spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(frame, bench, chars=chars).collect()
    assert planted <= {(r.doc_id, r.item_id) for r in rows}
    texts, passages = dict(docs), dict(items)
    for r in rows:
        part = " ".join(texts[r.doc_id][r.start:r.stop].lower().split())
        passage = " ".join(passages[r.item_id].lower().split())
        assert least_edits(part, passage) <= r.edits + 2 and r.edits <= len(passage) * EDIT_RATE
    flagged = {r.doc_id for r in rows}
    for d, t in docs:
        if d not in flagged:
            low = " ".join(t.lower().split())
            assert all(least_edits(" ".join(p.lower().split()), low) > 0 for _, p in items if p and len(p) > 40)
    left = decontaminated(frame, bench, chars=chars)
    assert {r.doc_id for r in left.collect()} == ({d for d, _ in docs} | {500, 501}) - flagged
    assert left.columns == frame.columns


def test_empty_tables_and_long_text(spark):
    docs, items, _ = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = ("filler " * 150_000) + items[0][1]
    frame = spark.createDataFrame([(None, long, "x"), (None, long, "x")], "doc_id long, text string, item_id string")
    got = contamination(frame.drop("item_id"), bench).collect()
    assert [(r.doc_id, r.item_id, r.start, r.edits) for r in got] == [(None, 0, len("filler ") * 150_000, 0)] * 2
    assert decontaminated(frame, bench).count() == 0
    assert contamination(frame.drop("item_id"), bench.limit(0)).count() == contamination(frame.drop("item_id").limit(0), bench).count() == 0
    assert decontaminated(frame, bench.limit(0)).count() == 2
    assert PassageIndex.of([]).ids == []


def test_query_finds_all_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for p in [" ".join(r.text.lower().split())] if any(i in p for i in items.values())}
    assert {r.doc_id for r in op1_benchmark_decontamination(spark, sf).collect()} == exact


def test_short_items_are_found(spark):
    items = [(1, "What is H2O?"), (2, "日本の首都はどこですか"), (3, "π≈3"), (4, " "), (5, ""), (6, None), (7, "Who wrote Hamlet in 1601?")]
    docs = [(1, "so: what  is h2o? water"), (2, "問題。日本の首都はどこですか。東京"), (3, "as π≈3 here and π≈3"), (4, "what is it"), (5, ""), (6, None), (7, "π≈"), (8, "3 who wrote hamlet in 1602?")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.stop, r.edits) for r in contamination(frame, bench).collect())
    assert got == [(1, 1, 4, 17, 0), (2, 2, 3, 14, 0), (3, 3, 3, 6, 0), (3, 3, 16, 19, 0), (8, 7, 2, 27, 1)]
    assert {r.doc_id for r in decontaminated(frame, bench).collect()} == {4, 5, 6, 7}


def within(passage, text):
    return least_edits(passage, text) <= int(len(passage) * EDIT_RATE)


@pytest.mark.parametrize("seed", range(6))
def test_all_matches_against_plain_alignment(seed, monkeypatch):
    """Every item and every passage of a long one, aligned with every whole text."""
    monkeypatch.setattr(decontaminate, "PASSAGE", 30)
    monkeypatch.setattr(decontaminate, "STEP", 15)
    rng = random.Random(seed)
    letters = "abcdefgh " if seed % 2 else "xyé日 "
    draw = lambda n: " ".join("".join(rng.choices(letters, k=n)).split())
    items = [t for t in (draw(rng.randint(8, 90)) for _ in range(12)) if len(t) >= 6]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        first = rng.choice([0, 0, rng.randrange(len(item) - 5)])
        part = item[first:] if rng.random() < 0.7 else item[first:first + 32]
        docs.append(" ".join((draw(rng.randint(0, 60)) + edited(rng, part, rng.randint(0, 4)) + draw(rng.randint(0, 60))).split()))
    got = passages_in(Texts.of(pa.array(docs)), PassageIndex.of(list(enumerate(items))))
    whole = {(d, i) for d, t in enumerate(docs) for i, p in enumerate(items) if within(p, t)}
    assert {(d, i) for d, i, *_, w in got if w} == whole
    passages = {i: [p[a:a + 30] for a in [*range(0, len(p) - 30, 15), len(p) - 30]] for i, p in enumerate(items) if len(p) > 30}
    partly = {(d, i) for d, t in enumerate(docs) for i, ps in passages.items() if any(within(p, t) for p in ps)}
    assert whole | partly == {(d, i) for d, i, *_ in got}
    for d, i, start, stop, edits, w in got:
        if w:
            assert least_edits(docs[d][start:stop], items[i]) <= edits <= int(len(items[i]) * EDIT_RATE)
        else:
            assert stop - start >= 30 - edits and edits <= 2


def test_part_of_a_long_item(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=5)) for _ in range(n))
    item, other = draw(200), draw(40)
    part = item[300:300 + PASSAGE + STEP - 1]
    docs = [(1, f"{other} {part} {other}"), (2, item[300:300 + PASSAGE - 20]), (3, f"{item} {other} {item[:400]}"), (4, other)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {}
    for r in contamination(frame, bench).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.edits, r.whole))
    assert got.keys() == {1, 3}
    (start, stop, edits, whole), = got[1]
    assert not whole and len(other) - 9 <= start and stop <= len(other) + 10 + len(part) and stop - start >= PASSAGE - 8
    assert sorted(got[3])[0] == (0, len(item), 0, True) and len(got[3]) == 2
    assert {r.doc_id for r in decontaminated(frame, bench).collect()} == {2, 4}


def test_ties_null_items_and_clashing_columns(spark):
    """Two items at one place both count; an item without id is an item too."""
    items = [(1, "the very same question here"), (2, "The very same  question here"), (None, "another question without any id")]
    docs = [(1, "ask the very same question here now"), (1, "ask the very same question here now"), (None, "another question without any id")]
    frame = spark.createDataFrame([(*d, 5, "s", True) for d in docs], "doc_id long, text string, Start int, ITEM_ID string, whole boolean")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.stop) for r in contamination(frame, bench).collect()), key=str)
    assert got == [(1, 1, 4, 31), (1, 1, 4, 31), (1, 2, 4, 31), (1, 2, 4, 31), (None, None, 0, 31)]
    assert decontaminated(frame, bench).count() == 0
    assert decontaminated(frame, bench.filter("item_id = 1")).collect()[0].ITEM_ID == "s"


def test_memory_is_bounded_by_blocks_of_text():
    """Hits of a large batch of texts are not held at once; matches are those of each text alone."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, draw(30)) for i in range(50)]
    index = PassageIndex.of(items)
    texts = [f"{draw(150)} {items[i % 50][1]} {draw(150)}" if i % 100 == 0 else draw(300) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1500)), "text": texts})
    tracemalloc.start()
    found = [(b.column("doc_id")[m[0]].as_py(), *m[1:]) for b, some in decontaminate.matches_by_block(iter([batch]), index) for m in some]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3 << 20 and peak < 300 << 20, peak
    assert {(m[0], m[1]) for m in found} >= {(i, i % 50) for i in range(0, 1500, 100)}
    alone = [(i, *m[1:]) for i in (0, 100, 101, 1499) for m in passages_in(Texts.of(pa.array([texts[i]])), index)]
    assert alone == [m for m in found if m[0] in (0, 100, 101, 1499)]
