"""Count-min sketches of hashes, built part by part and merged by range of cells.

Each task counts its own hashes and sends the cells it touched, split by range, so no
task ever holds or sends a whole sketch. Merging keeps one bit a cell: counted at least
so often or not. The bits are the only thing that meets in one place; their number is
bounded by ``MOST_CELLS`` whatever the data. An overfull sketch answers yes more often,
which costs work later but never loses a repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix

RANGE_BITS = 20
#: 128 MB as bits, the most that is broadcast.
MOST_CELLS = 1 << 30
_PENDING = 4_000_000
_IN_RANGE = np.uint32((1 << RANGE_BITS) - 1)

Hashes = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def cell_bits(items: float, each: int) -> int:
    """Bits of a cell number for ``each`` cells an item, within the bound."""
    cells = max(1 << RANGE_BITS, min(MOST_CELLS, int(items) * each))
    return (cells - 1).bit_length()


def packed(rising: np.ndarray) -> bytes:
    """Rising 32-bit numbers as differences, byte by place value: the upper bytes are
    nearly all zero, which the shuffle's compression takes away."""
    return np.diff(rising, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.uint32).ravel(), dtype=np.uint32)


def _cells(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x9E37 * (row + 1))) >> np.uint64(64 - bits)).astype(np.int64)


def counted_cells(parts: list[np.ndarray], bits: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The rising distinct cells that hashes fall into, and which are met again: 32-bit numbers,
    filled array by array and sorted in place, as there may be some million."""
    cells, at = np.empty(sum(map(len, parts)), np.uint32), 0
    for found in parts:
        cells[at:at + len(found)] = _cells(found, bits, row) + (row << bits)
        at += len(found)
    cells.sort()
    first = np.ones(len(cells), bool)
    np.not_equal(cells[1:], cells[:-1], out=first[1:])
    again = np.zeros(len(cells), bool)
    np.logical_not(first[1:], out=again[:-1])
    return cells[first], again[first]


def count_sketch(docs: DataFrame, hashes: Hashes, bits: int, depth: int, least: int, most: int = _PENDING) -> np.ndarray:
    """Packed bits of the cells that at least ``least`` (1 or 2) of the hashes fall into.

    Each of the ``depth`` hash functions has ``2^bits / depth`` cells or, for a depth of
    one, all; ``hashes`` runs in tasks and yields arrays of 64-bit hashes, of which a task
    counts about ``most`` at a time.
    """
    own = bits - (depth - 1).bit_length()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for row in range(depth):
                cells, again = counted_cells(pending, own, row)
                # cells rise, so a range's are together
                edges = np.searchsorted(cells, np.arange(row << own, row + 1 << own, 1 << RANGE_BITS)) if len(cells) else np.empty(0, np.int64)
                ends = np.append(edges[1:], len(cells))
                edges, ends = edges[edges < ends], ends[edges < ends]
                pieces = [packed((cells[a:b] & _IN_RANGE) * np.uint32(2) + again[a:b]) for a, b in zip(edges, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cells[edges] >> np.uint32(RANGE_BITS), pa.int64()), pa.array(pieces, pa.binary())], names=["part", "cells"])

        pending, n = [], 0
        for found in hashes(batches):
            pending.append(found)
            n += len(found)
            if n > most:
                yield from part(pending)
                pending, n = [], 0
        yield from part(pending)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        seen = np.zeros(1 << RANGE_BITS, np.uint8)
        for chunk in group.column("cells").to_pylist():
            coded = unpacked(chunk)
            at = coded >> 1
            seen[at] = np.minimum(seen[at] + 1 + (coded & 1).astype(np.uint8), 2)
        return pa.table({"part": [key[0].as_py()], "bits": pa.array([np.packbits(seen >= least, bitorder="little").tobytes()], pa.binary())})

    merged = docs.mapInArrow(emit, "part long, cells binary").groupBy("part").applyInArrow(merge, "part long, bits binary")
    out = np.zeros(1 << (own - 3), np.uint8) if depth == 1 else np.zeros((1 << (own - 3)) * depth, np.uint8)
    width = 1 << (RANGE_BITS - 3)
    for part, bits_ in merged.collect():  # MOST_CELLS bits at most
        out[part * width:(part + 1) * width] = np.frombuffer(bits_, np.uint8)
    return out


def may_have(sketch: np.ndarray, hashes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Whether each hash may have been counted so often; never no where it has been."""
    own = bits - (depth - 1).bit_length()
    yes = np.ones(len(hashes), bool)
    for row in range(depth):
        at = _cells(hashes, own, row) + (row << own)
        yes &= (sketch[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return yes
