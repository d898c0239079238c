"""Counted cells against a plain count, and what counting them holds."""

import tracemalloc

import numpy as np

from flowlucid.llm.sketch import _cells, counted_cells


def test_cells_against_a_plain_count():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3000, n).astype(np.uint64) for n in (0, 1, 2000, 900)]
    for bits, row in ((20, 0), (9, 2)):
        cells, again = counted_cells(parts, bits, row)
        plain, counts = np.unique(_cells(np.concatenate(parts), bits, row) + (row << bits), return_counts=True)
        assert np.array_equal(cells, plain) and np.array_equal(again, counts >= 2)
    assert not len(counted_cells([], 20, 0)[0])


def test_counting_holds_little_more_than_the_hashes():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1 << 62, 100_000).astype(np.uint64) for _ in range(20)]
    tracemalloc.start()
    counted_cells(parts, 26, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(p.nbytes for p in parts), peak
