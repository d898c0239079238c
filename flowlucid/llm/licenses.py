"""Licences in texts: fixed phrases, and an exact set-similarity join with licence notices.

A text is cut into overlapping blocks of words; a block and a notice are sets of words. A
block is found if it holds at least ``percent`` of a notice's words. Words are put in one
global order, rare ones first, by a count over all texts. Then for a notice of t words that
needs c of them only blocks are compared

* that hold one of the notice's first t - c + 1 words (prefix filter),
* that have at least c words of the notices' vocabulary (length filter),
* and where at least c - 1 of those come behind the shared word (positional filter),

none of which can lose a block that reaches the threshold; the overlap of the rest is counted.
The notices are a parameter of bounded size and sent to every task; texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ship_package
from .frames import dropping, schema_with
from .text import SIGNS, Texts, Words, blocks, signed

# Phrases that name a licence, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The opening words of common licence notices, by label.
NOTICES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so",
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list"
        " of conditions and the following disclaimer",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl": ["made available under the terms of the Eclipse Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc": [
        "Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-nc": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication"],
}

PERCENT = 90
#: The notices' words are sent to every task; more of them are refused.
MAX_NOTICE_WORDS = 1_000_000


def _words(texts: Sequence[str | None]) -> Words:
    return Texts.of(pa.array(texts, pa.string())).words(lower=True, between=SIGNS)


@dataclass
class Sized:
    """Notices that share a block width of ``2 * step`` words, none longer than ``step``."""

    step: int
    labels: list[str]
    vocabulary: np.ndarray  # rising hashes
    rank: np.ndarray  # place in the global order, by vocabulary entry
    size: np.ndarray  # distinct words of each notice
    need: np.ndarray  # words of it that a block must hold
    first: np.ndarray  # prefix lists: notices[first[r]:first[r + 1]] begin with the word ranked r
    notices: np.ndarray
    members: np.ndarray  # rising rank * notices + notice

    @classmethod
    def of(cls, step: int, labels: list[str], sets: list[np.ndarray], seen: Mapping[int, int], percent: int) -> Sized:
        vocabulary = np.unique(np.concatenate(sets))
        counts = np.array([seen.get(int(h), 0) for h in signed(vocabulary)], dtype=np.int64)
        rank = np.empty(len(vocabulary), dtype=np.int64)
        rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
        size = np.array([len(s) for s in sets])
        need = -(-size * percent // 100)
        ranked = [np.sort(rank[np.searchsorted(vocabulary, s)]) for s in sets]
        prefix = [r[:len(r) - c + 1] for r, c in zip(ranked, need, strict=True)]
        words = np.concatenate(prefix)
        owners = np.repeat(np.arange(len(sets)), [len(p) for p in prefix])
        order = np.argsort(words, kind="stable")
        first = np.searchsorted(words[order], np.arange(len(vocabulary) + 1))
        members = np.sort(np.concatenate([r * len(sets) + i for i, r in enumerate(ranked)]))
        return cls(step, labels, vocabulary, rank, size, need, first, owners[order], members)

    def found(self, words: Words) -> tuple[np.ndarray, ...]:
        """Text, block, notice and overlap of every block that holds enough of a notice."""
        entry = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[entry] == words.hashes)
        text = np.searchsorted(words.last, at, side="right")
        block = (at - words.first[text]) // self.step
        # a word lies in the block that begins at its step and in the one before
        both = np.concatenate([np.arange(len(at)), np.flatnonzero(block > 0)])
        block = np.concatenate([block, block[block > 0] - 1])
        many = int(block.max()) + 1 if len(block) else 1
        keys = np.unique((text[both] * many + block) * len(self.rank) + self.rank[entry[at[both]]])
        home, rank = np.divmod(keys, len(self.rank))
        homes, start, sizes = np.unique(home, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(homes)), sizes)
        behind = np.repeat(start + sizes, sizes) - np.arange(len(keys))  # this word and those behind it
        lists = self.first[rank + 1] - self.first[rank]
        total = int(lists.sum())
        of = np.repeat(np.arange(len(keys)), lists)
        notice = self.notices[np.arange(total) - np.repeat(np.cumsum(lists) - lists, lists) + np.repeat(self.first[rank], lists)]
        passes = behind[of] >= self.need[notice]  # length and positional filter
        pairs = np.unique(place[of[passes]] * len(self.size) + notice[passes])
        place, notice = np.divmod(pairs, len(self.size))
        many_words = sizes[place]
        ends = np.cumsum(many_words)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[place] - (ends - many_words), many_words)
        probe = rank[inside] * len(self.size) + np.repeat(notice, many_words)
        hit = self.members[np.minimum(np.searchsorted(self.members, probe), len(self.members) - 1)] == probe
        overlap = np.add.reduceat(hit.astype(np.int64), ends - many_words) if len(ends) else np.empty(0, np.int64)
        enough = overlap >= self.need[notice]
        text, block = np.divmod(homes[place[enough]], many)
        return text, block, notice[enough], overlap[enough]


def notice_words(docs: DataFrame, vocabulary: np.ndarray, text: str) -> dict[int, int]:
    """How often each hash of ``vocabulary`` (rising) occurs as a word of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in blocks(batches, text):
            hashes = Texts.of(batch.column(text)).words(lower=True, between=SIGNS).hashes
            entry = np.minimum(np.searchsorted(shared.value, hashes), len(total) - 1)
            total += np.bincount(entry[shared.value[entry] == hashes], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(signed(shared.value)[total > 0]), pa.array(total[total > 0])], names=["word", "n"])

    counted = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # at most one row for each word of the notices


def licenses(
    docs: DataFrame, notices: Mapping[str, Sequence[str]] | None = None, phrases: Mapping[str, str] | None = None,
    percent: int = PERCENT, text: str = "text",
) -> DataFrame:
    """Licences of each text: the input columns but the text, then ``n_words``, ``n_base``
    (places where a phrase's words stand one after the other), ``first_word`` and ``last_word``
    (where the first and the last of these begin), ``base_labels``, ``labels`` (those of
    notices too; sorted, joined by commas), ``blocks`` (label, first word, word after the last
    and share of the notice for each block found) and ``score``: 1 where a phrase stands, else
    the greatest share of a notice found in a block, else 0.

    A block is the ``2 * step`` words from a multiple of ``step`` on, where ``step`` is the
    power of two not below the notice's length; so a notice as a whole always lies in one.
    A null or empty text, and one without words, has neither places nor blocks. Rows are
    independent: repeated rows and repeated or null ids each give their row, an empty table an
    empty one. Input columns with one of the result's names are replaced.
    """
    ship_package(docs.sparkSession)
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases
    listed = [(label, one) for label, many in notices.items() for one in many]
    words = _words([one for _, one in listed])
    if len(words.hashes) > MAX_NOTICE_WORDS:
        raise ValueError(f"notices of more than {MAX_NOTICE_WORDS} words would be sent to every task")
    by_step: dict[int, tuple[list[str], list[np.ndarray]]] = {}
    for (label, _), a, b in zip(listed, words.first.tolist(), words.last.tolist(), strict=True):
        if a < b:
            labels, sets = by_step.setdefault(1 << (b - a - 1).bit_length(), ([], []))
            labels.append(label)
            sets.append(np.unique(words.hashes[a:b]))
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "blocks", "score"]
    source = dropping(docs, *added)
    seen = notice_words(source, np.unique(words.hashes), text) if by_step else {}
    sized = [Sized.of(step, labels, sets, seen, percent) for step, (labels, sets) in sorted(by_step.items())]
    spoken = _words(list(phrases))
    named = [(label, spoken.hashes[a:b]) for label, a, b in zip(phrases.values(), spoken.first, spoken.last, strict=True) if a < b]
    shared = docs.sparkSession.sparkContext.broadcast((sized, named))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized, named = shared.value
        for batch in blocks(batches, text):
            words = Texts.of(batch.column(text)).words(lower=True, between=SIGNS)
            n = batch.num_rows
            length = (words.last - words.first).astype(np.int64)
            many, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            block_rows: list[list] = [[] for _ in range(n)]
            for label, phrase in named:
                at = np.flatnonzero(words.hashes == phrase[0])
                owner = np.searchsorted(words.last, at, side="right")
                fits = at + len(phrase) <= words.last[owner]
                at, owner = at[fits], owner[fits]
                for k in range(1, len(phrase)):
                    same = words.hashes[at + k] == phrase[k]
                    at, owner = at[same], owner[same]
                np.add.at(many, owner, 1)
                np.minimum.at(low, owner, at - words.first[owner])
                np.maximum.at(high, owner, at - words.first[owner])
                for i in np.unique(owner).tolist():
                    base[i].add(label)
            for one in sized:
                for i, b, t, overlap in zip(*(x.tolist() for x in one.found(words)), strict=True):
                    stop = min((b + 2) * one.step, int(length[i]))
                    block_rows[i].append({"label": one.labels[t], "start": b * one.step, "stop": stop, "share": overlap / int(one.size[t])})
            for found in block_rows:
                found.sort(key=lambda r: (r["start"], r["stop"], r["label"], -r["share"]))
            columns = [
                pa.array(length), pa.array(many),
                pa.array(low, pa.int64(), mask=many == 0), pa.array(high, pa.int64(), mask=many == 0),
                pa.array([",".join(sorted(s)) for s in base], pa.string()),
                pa.array([",".join(sorted(s | {r["label"] for r in found})) for s, found in zip(base, block_rows, strict=True)], pa.string()),
                pa.array(block_rows, kind),
                pa.array([1.0 if s else max((r["share"] for r in found), default=0.0) for s, found in zip(base, block_rows, strict=True)], pa.float64()),
            ]
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *added])

    result = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " blocks array<struct<label: string, start: bigint, stop: bigint, share: double>>, score double"
    )
    return source.mapInArrow(scan, schema_with(source, result, without=text))
