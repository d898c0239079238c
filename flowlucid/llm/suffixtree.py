"""Suffix trees of word sequences, and how far two places of a sequence agree.

Ukkonen's construction reads the sequence once. A tour of the finished tree writes down the
length of each leaf's suffix and, between two children, that of the inner node they hang from:
two suffixes share as many words as the least number between their leaves, which a table of
minima over spans of 2^k entries gives at once (the lowest common ancestor by range minimum).
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """The tree of ``words`` (numbers from 1 on) and an end mark, 0, less than any of them."""

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.words = [*words, 0]
        self.symbols = max(self.words) + 1
        self._grow()
        self._order()

    def _grow(self) -> None:
        words, symbols, total = self.words, self.symbols, self.n + 1
        begin, end, link = [0], [0], [0]  # by node; the root is 0, a leaf ends with the sequence
        child: dict[int, int] = {}  # parent * symbols + first word of the edge
        node, edge, length, waiting = 0, 0, 0, 0
        for at, word in enumerate(words):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = at
                key = node * symbols + words[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(at)
                    end.append(total)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = begin[below]
                    span = min(end[below], at + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if words[first + length] == word:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(begin)
                    child[key] = middle
                    child[middle * symbols + words[first + length]] = below
                    child[middle * symbols + word] = middle + 1
                    begin += (first, at)
                    end += (first + length, total)
                    link += (0, 0)
                    begin[below] = first + length
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self.begin, self.end = np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)
        self.edges = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))

    def _order(self) -> None:
        depths, leaves = self._tour(backward=False)
        self.place = np.empty(self.n + 1, dtype=np.int64)
        self.place[leaves[1]] = leaves[0]
        self.minima = [np.array(depths, dtype=np.int32)]
        while 2 << (len(self.minima) - 1) <= len(depths):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _tour(self, backward: bool) -> tuple[list[int], np.ndarray]:
        """Lengths along the tour, and place and suffix of each leaf on it, children in the
        order of their first word or against it, the end mark first in both cases."""
        keys, below = self.edges
        parent, word = np.divmod(keys, self.symbols)
        order = np.lexsort((np.where(word > 0, self.symbols - word, 0) if backward else word, parent))
        children = below[order].tolist()
        first = np.searchsorted(parent[order], np.arange(len(self.begin) + 1)).tolist()
        span = (self.end - self.begin).tolist()
        depth = [0] * len(span)
        depths, places, suffixes = [], [], []
        todo, total = [0], self.n + 1
        while todo:
            node = todo.pop()
            if node < 0:
                depths.append(depth[~node])
                continue
            low, high = first[node], first[node + 1]
            here = depth[node]
            if low == high:
                places.append(len(depths))
                suffixes.append(total - here)
                depths.append(here)
                continue
            for k in range(high - 1, low, -1):
                c = children[k]
                depth[c] = here + span[c]
                todo += (c, ~node)
            c = children[low]
            depth[c] = here + span[c]
            todo.append(c)
        return depths, np.array([places, suffixes], dtype=np.int64)

    def ranks(self, backward: bool) -> np.ndarray:
        """The rank of every suffix, the empty one included, in the order of the words' numbers
        or against it; the end mark is the least in both."""
        suffixes = self._tour(True)[1][1] if backward else np.argsort(self.place)
        rank = np.empty(self.n + 1, dtype=np.int64)
        rank[suffixes] = np.arange(self.n + 1)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes from ``a`` and from ``b`` (not equal) share."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place: up to the next suffix of lower rank."""
    values, open_, out = rank.tolist(), [], [0] * (len(rank) - 1)
    for i, r in enumerate(values):
        while open_ and values[open_[-1]] > r:
            j = open_.pop()
            out[j] = i - j
        open_.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(words: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of every maximal stretch of at least ``least`` words and twice its
    smallest period, by start and period.

    Every such stretch holds, for one of the two orders of words, the longest Lyndon word from
    some place as its root; so all those roots are candidates, extended to both sides.
    """
    n = len(words)
    ids = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(ids)
    found = []
    for backward in (False, True):
        period = lyndon_lengths(tree.ranks(backward))
        start = np.flatnonzero(period <= n // 2)
        found.append(np.stack([start, period[start]]))
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    stop = start + period
    inner = stop < n
    stop[inner] += tree.common(start[inner], stop[inner])
    # what cannot reach the length to the left is not looked at in the other tree
    some = stop >= 2 * period
    start, stop, period = start[some], stop[some], period[some]
    del tree
    back = SuffixTree(ids[::-1])
    left = np.zeros(len(start), dtype=np.int64)
    inner = start > 0
    left[inner] = back.common(n - start[inner], n - start[inner] - period[inner])
    start = start - left
    length = stop - start
    runs = np.stack([start, length, period], axis=1)[(length >= 2 * period) & (length >= least)]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
