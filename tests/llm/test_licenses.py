"""Licences against a comparison of every block with every notice."""

import random
import re

import numpy as np
import pytest

from flowlucid.llm.licenses import NOTICES, PHRASES, Sized, _words, licenses

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, notices, phrases, percent):
    words, places, base, blocks = words_of(text), [], set(), []
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    for label, many in notices.items():
        for one in many:
            notice = words_of(one)
            step = 1
            while step < len(notice):
                step *= 2
            for start in range(0, len(words), step):
                common = len(set(notice) & set(words[start:start + 2 * step]))
                if 100 * common >= percent * len(set(notice)):
                    blocks.append((start, min(start + 2 * step, len(words)), label, common / len(set(notice))))
    labels = base | {b[2] for b in blocks}
    score = 1.0 if base else max((b[3] for b in blocks), default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), sorted(blocks), score)


def got(frame):
    return {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, sorted((b.start, b.stop, b.label, b.share) for b in r.blocks), r.score)
        for r in frame.collect()
    }


def texts(seed, n=150):
    rng = random.Random(seed)
    common = ["the", "of", "license", "under", "été", "4", "software", "Straße", "by", "cc", "public", *(f"w{i}" for i in range(60))]
    whole = [one for many in NOTICES.values() for one in many]
    out = [None, "", " .,-", "MIT License", "mit-license mit\nlicense", "the General Public License", "mit"]
    for _ in range(n):
        parts = [" ".join(rng.choices(common, k=rng.randint(0, 70)))]
        for _ in range(rng.randint(0, 2)):
            notice = words_of(rng.choice(whole))
            for _ in range(rng.randint(0, 1 + len(notice) // 8)):
                notice[rng.randrange(len(notice))] = rng.choice(common)
            parts += [" ".join(notice).upper() if rng.random() < 0.3 else "\n".join(notice), " ".join(rng.choices(common, k=rng.randint(0, 200)))]
        if rng.random() < 0.3:
            parts.append(rng.choice(["Apache, License", "GENERAL public license!", "MIT License"]))
        out.append(rng.choice([" ", ". "]).join(parts))
    return out


@pytest.mark.parametrize("percent", [90, 75, 100])
def test_against_all_blocks(spark, percent):
    rows = list(enumerate(texts(percent)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = {i: plain(t, NOTICES, PHRASES, percent) for i, t in rows}
    assert got(licenses(docs, percent=percent)) == expected
    assert sum(bool(e[6]) for e in expected.values()) > 20 and any(not e[5] for e in expected.values())


def test_filters_lose_nothing_in_any_order():
    rng = random.Random(4)
    letters = [f"t{i}" for i in range(12)]
    for _ in range(200):
        sets = [rng.sample(letters, rng.randint(1, 8)) for _ in range(4)]
        texts_ = [" ".join(rng.choices([*letters, "x"], k=rng.randint(0, 40))) for _ in range(5)]
        hashes = [np.unique(_words([" ".join(s)]).hashes) for s in sets]
        seen = {int(h): rng.randint(0, 5) for s in hashes for h in s.view(np.int64)}
        one = Sized.of(8, ["x"] * 4, hashes, seen, 60)
        found = {(i, b, t): o for i, b, t, o in zip(*(x.tolist() for x in one.found(_words(texts_))), strict=True)}
        expected = {}
        for i, text in enumerate(texts_):
            words = text.split()
            for b in range(-(-len(words) // 8)):
                for t, s in enumerate(sets):
                    common = len(set(s) & set(words[8 * b:8 * b + 16]))
                    if 100 * common >= 60 * len(s):
                        expected[i, b, t] = common
        assert found == expected


def test_planted_lines(spark):
    rows = [(1, "lorem ipsum. Licensed under CC BY-NC 4.0. dolor"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "clean words only"), (4, "cc by the license")]
    found = {r.doc_id: (r.base_labels, r.labels, r.score) for r in licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("", "cc,cc-nc", 1.0), 2: ("gpl", "gpl", 1.0), 3: ("", "", 0.0), 4: ("", "", 0.0)}


def test_edges(spark):
    long = "word " * 300_000 + "Released under the MIT License."
    rows = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, "MIT License", None, 2), (3, long, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Labels string, score int")
    found = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in licenses(docs).collect())
    assert found == [
        ("1", 0, 0, None, None, "", 0.0), ("2", 0, 0, None, None, "", 0.0), ("2", 0, 0, None, None, "", 0.0),
        ("3", 300_005, 1, 300_003, 300_003, "mit", 1.0), ("None", 2, 1, 0, 0, "mit", 1.0),
    ]
    assert licenses(docs.limit(0)).count() == 0
    assert licenses(docs, notices={}, phrases={}).filter("labels <> '' or score > 0").count() == 0
    assert licenses(docs, notices={"x": [" - "]}).count() == 5
