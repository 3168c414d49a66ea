"""Levelled families of sorted runs: the index that grows batch by batch.

A family holds sorted runs of 64-bit keys, each key in one run only, with payload columns beside them. A new batch is
merge-scanned against every level. Keys that a level holds fold their payload into it; the rest (the anti-join) become
a new run at level 0. Two runs of one level merge into one of the next, so n batches leave at most log2(n) + 1 runs and each
entry is copied log2(n) times.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Payload = list[np.ndarray]


class Family:
    def __init__(self, fold: Callable[[Payload, np.ndarray, Payload], None]):
        """``fold(held, at, new)`` adds the new payload to positions ``at`` (all different) of the held one, in place."""
        self.fold = fold
        self.levels: list[tuple[np.ndarray, Payload] | None] = []

    def add(self, keys: np.ndarray, *payload: np.ndarray) -> None:
        """One batch: keys sorted and distinct."""
        new = [p.copy() for p in payload]
        for level in self.levels:
            if level is None or not len(keys):
                continue
            held, columns = level
            at = np.searchsorted(held, keys)
            at[at == len(held)] = 0
            hit = held[at] == keys
            if hit.any():
                self.fold(columns, at[hit], [p[hit] for p in new])
                keys, new = keys[~hit], [p[~hit] for p in new]
        if not len(keys):
            return
        run, i = (keys, new), 0
        while i < len(self.levels) and self.levels[i] is not None:
            run, self.levels[i], i = merged(self.levels[i], run), None, i + 1
        self.levels[i : i + 1] = [run]

    def whole(self) -> tuple[np.ndarray, Payload]:
        """All levels as one run."""
        run = None
        for level in self.levels:
            if level is not None:
                run = level if run is None else merged(level, run)
        return run if run is not None else (np.zeros(0, np.uint64), [])

    def find(self, keys: np.ndarray, column: int, missing) -> np.ndarray:
        """The payload of keys in any order, from whichever level holds them."""
        out = np.full(len(keys), missing)
        for level in self.levels:
            if level is not None:
                held, columns = level
                at = np.searchsorted(held, keys)
                at[at == len(held)] = 0
                hit = held[at] == keys
                out[hit] = columns[column][at[hit]]
        return out


def merged(a: tuple[np.ndarray, Payload], b: tuple[np.ndarray, Payload]) -> tuple[np.ndarray, Payload]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], [np.concatenate([x, y])[order] for x, y in zip(a[1], b[1], strict=True)]
