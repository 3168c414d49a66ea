"""Sparse suffix arrays over text on both sides of anchors.

An entry is an anchor with the symbols before it (read backwards) and from it on. Two suffix arrays, one for each side, hold the entries in
the order of their symbols, with the common prefix of each with its neighbour. A window that begins ``o`` symbols before the anchor is the
same in two entries exactly if their left sides agree on ``o`` symbols and their right sides on the rest of the window, and in a sorted array
entries that agree on a length stand together, so both arrays cut at their common prefixes give the classes of equal windows. Symbols
are compared themselves, not by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._prints import U, ranges


def columns(data: np.ndarray, start: np.ndarray, end: np.ndarray, backwards: bool = False) -> np.ndarray:
    """The symbols of stretches as rows of 64-bit columns that sort in the order of the symbols; bytes go eight to a column."""
    n, size = len(start), end - start
    width = int(size.max()) if n else 0
    per = 8 // data.itemsize
    held = np.zeros((n, -(-width // per) * per), data.dtype)
    row, at = np.repeat(np.arange(n), size), ranges(np.zeros(n, np.int64), size)
    flat = data[ranges(start, end)]
    held[row, np.repeat(size, size) - 1 - at if backwards else at] = flat
    return held.view(">u8").astype(U) if data.itemsize == 1 else held


class SuffixArray:
    """Entries in the order of ``(group, symbols)``: each one's rank, and how many symbols it shares with the one before it."""

    def __init__(self, group: np.ndarray, symbols: np.ndarray, per: int):
        order = np.lexsort([*symbols.T[::-1], group])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        a, b = symbols[order[1:]], symbols[order[:-1]]
        common = np.full(max(len(order) - 1, 0), symbols.shape[1] * per, np.int64)
        if symbols.shape[1]:
            differ = a != b
            some = np.flatnonzero(differ.any(1))
            at = differ[some].argmax(1)
            common[some] = at * per
            if per > 1:  # equal leading bytes of the first column that differs
                odd = a[some, at] ^ b[some, at]
                for k in range(1, per):
                    common[some] += odd >> U(64 - 8 * k) == 0
        common[group[order[1:]] != group[order[:-1]]] = -1
        self.common = np.r_[-1, common] if len(order) else common

    def classes(self, rows: np.ndarray, length: int) -> np.ndarray:
        """A number for each of ``rows``, equal where the first ``length`` symbols and the groups are."""
        return np.cumsum(self.common < length)[self.rank[rows]]


def equal_windows(left: SuffixArray, right: SuffixArray, low: np.ndarray, high: np.ndarray, size: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance ``o`` of a window's start from the anchor: the entries that have one (``low <= o <= high``, and ``size`` symbols from the
    anchor on reach its end), and the numbers (from 0) of the classes of equal windows among them."""
    n = len(low)
    for o in range(int(low.min()) if n else 0, int(high.max()) + 1 if n else 0):
        rows = np.flatnonzero((low <= o) & (o <= high) & (size >= window - o))
        if len(rows):
            yield o, rows, np.unique(left.classes(rows, o) * (n + 1) + right.classes(rows, window - o), return_inverse=True)[1]
