"""Words and fingerprints of many texts at once, as numpy arrays inside tasks.

A column of texts arrives as one Arrow buffer. Everything here works on that buffer in
blocks of bounded size, so a very long text costs memory in proportion to itself and a
batch of short ones costs no Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK_BYTES = 4 << 20
_HASH_SPAN = 1 << 19
#: Elements summed at a time, few enough to stay in a core's cache.
_SUM_SPAN = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAMMA = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, controls and ASCII signs.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _GAMMA[0]
    x ^= x >> np.uint64(27)
    x *= _GAMMA[1]
    x ^= x >> np.uint64(31)
    return x


def _values(seed: int) -> np.ndarray:
    """One random odd number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


VALUES = (_values(11), _values(23))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse, modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.ones(-(-n // _HASH_SPAN) * _HASH_SPAN, dtype=np.uint64)
        known, step = 1, int(_BASE_INVERSE if inverse else _BASE)
        while known < len(have):  # in place, as the table may be a large part of what a task holds
            more = have[known:2 * known]
            np.multiply(have[:len(more)], np.uint64(step), out=more)
            known, step = 2 * known, step * step % (1 << 64)
        _powers[key] = have
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """For each range start <= stop of a sequence of 64-bit values, in rising order of
    starts, a hash of its content that does not depend on its place. With a ``table``, the
    sequence has the places in it; they are looked up part by part."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, low + _HASH_SPAN, side="right")))
        high = int(stops[at:upto].max())
        part = values[low:high] if table is None else table[values[low:high]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(len(part)), out=total[1:])
        out[at:upto] = hashes_between(total, starts[at:upto] - low, stops[at:upto] - low)
        at = upto
    return out


def running_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What ``hashes_between`` needs of the sequence with the places ``data`` in ``table``, for
    any number of ranges; worked out part by part."""
    total, weights = np.zeros(len(data) + 1, dtype=np.uint64), powers(len(data))
    for low in range(0, len(data), _SUM_SPAN):
        part = table[data[low:low + _SUM_SPAN]]
        part *= weights[low:low + _SUM_SPAN]
        part[:1] += total[low:low + 1]
        np.cumsum(part, out=total[low + 1:low + 1 + len(part)])
    return total


def hashes_between(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """``range_hashes`` from the sequence's running sums, in any order of starts."""
    summed = total[stops]
    summed -= total[starts]
    summed *= powers(len(total), inverse=True)[starts]
    summed += (stops - starts).astype(np.uint64) * _GAMMA[1]
    return mix(summed)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, by its first place."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(n)
    return range_hashes(values, starts, starts + width)


@dataclass
class Texts:
    """Texts as one byte array; text ``i`` is ``data[starts[i]:stops[i]]``. Null is empty."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
        starts, stops = at[:-1], at[1:]
        if column.null_count:
            stops = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, stops)
        low, high = (int(at[0]), int(at[-1])) if len(at) > 1 else (0, 0)
        return cls(raw[low:high], starts - low, stops - low)

    def words(self, lower: bool = False, between: np.ndarray = SPACE) -> Words:
        """The runs of bytes other than ASCII white space, or than those marked in ``between``."""
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        solid = np.zeros(n + 1, dtype=bool)
        np.logical_not(between[data], out=solid[:n])
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = solid[:-1]
        edges = self.starts[self.starts < self.stops]
        first = solid & ~before
        first[edges] = solid[edges]
        last = before & ~solid
        last[edges] |= before[edges]
        start, stop = np.flatnonzero(first), np.flatnonzero(last)
        bounds = np.searchsorted(start, self.starts), np.searchsorted(start, self.stops)
        hashes = range_hashes(data, start, stop, VALUES[0]) if len(start) else np.empty(0, np.uint64)
        return Words(start, stop, hashes, bounds[0], np.maximum(*bounds))


@dataclass
class Words:
    """Words of some texts: their bytes' range and hash; text ``i`` has words ``first[i]:last[i]``."""

    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first)), self.last - self.first)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        sizes = pa.compute.binary_length(texts.fill_null(b""))
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
