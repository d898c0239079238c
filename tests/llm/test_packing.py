"""Packing: ids against the tokenizer itself, sequences against the contract."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlucid.llm.packing import best_fit_rounds, pack, pack_documents, token_pieces
from flowlucid.llm.queries import op7_best_fit_packing

from ..conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Longest first, each into the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return sorted(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_rounds_equal_one_by_one(counts):
    used = defaultdict(list)
    for length, first, last, sequence, each, offset in best_fit_rounds(counts, 40):
        for r in range(first, last):
            used[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    seen = defaultdict(int)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
            seen[length] += 1
        assert at <= 40
    assert dict(seen) == counts
    assert sorted(40 - sum(n for _, n in p) for p in used.values()) == plain_best_fit([n for n, c in counts.items() for _ in range(c)], 40)


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            cut = ids[r.piece * capacity:(r.piece + 1) * capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(cut))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    used, least = check(op7_best_fit_packing(spark, SMALL).collect(), texts, 2048)
    assert used <= least * 1.02 + 1


def test_odd_texts(spark):
    odd = ["", None, "  \n", "A b\x1cc\x85d", "é ́x", "<|endoftext|> x<|startoftext|>y", "don't WE'LL İ ΑΣ", "word " * 9000, "x" * 3000, "one\ttwo", "one\ttwo"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    check(pack_documents(docs, PATH, capacity=64).collect(), dict(enumerate(odd)), 64)


def test_repeated_rows_extra_columns_and_empty(spark):
    rows = [(None, "a b", 1, "s")] * 3 + [(5, None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, source string")
    got = pack_documents(docs, PATH).collect()
    assert len(got) == 4 and {r.source for r in got} == {"s", None}
    assert sorted(r.offset for r in got) == [0, 3, 6, 9]
    assert pack_documents(docs.limit(0), PATH).count() == 0
    assert "ids" in token_pieces(docs, PATH, with_ids=True).columns


@pytest.mark.parametrize("seed", [1])
def test_hot_length(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 0, 700 if i % 3 else rng.randint(1, 2048)) for i in range(3000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long")).collect()
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 3000 and max(used.values()) <= 2048
    assert len(used) == len(plain_best_fit([r[2] for r in rows], 2048))


def test_pieces_equal_in_every_column(spark):
    rows = [(1, 0, 700, 5)] * 50 + [(None, None, 700, 5)] * 7 + [(2, 0, 1300, 9)] * 20
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").repartition(5)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(got) == len(rows) and len(by) == len(plain_best_fit([r[2] for r in rows], 2048))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
