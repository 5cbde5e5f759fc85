"""Rows of one block in numpy arrays: products, and triangles solved level by level.

A level of a triangle holds the rows that depend on rows of earlier levels only, so a sweep is one numpy step a level
instead of one Python step an entry.
"""

from __future__ import annotations

import numpy as np


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[k], start[k] + 1, ... of all k, one after the other."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


class Csr:
    """Entries by row and column; equal places are summed."""

    def __init__(self, n: int, row, col, val):
        row, col, val = np.asarray(row, np.int64), np.asarray(col, np.int64), np.asarray(val, float)
        key, at = np.unique(row * n + col, return_inverse=True)
        self.n, self.row, self.col = n, key // max(n, 1), key % max(n, 1)
        self.val = np.bincount(at, weights=val, minlength=len(key))

    @classmethod
    def of_rows(cls, rows: list[dict[int, float]]) -> "Csr":
        count = [len(r) for r in rows]
        return cls(len(rows), np.repeat(np.arange(len(rows)), count), [c for r in rows for c in r], [v for r in rows for v in r.values()])

    def rows(self) -> list[dict[int, float]]:
        """Rows as dicts column -> value, columns in order."""
        ends = np.searchsorted(self.row, np.arange(self.n + 1)).tolist()
        col, val = self.col.tolist(), self.val.tolist()
        return [dict(zip(col[a:b], val[a:b])) for a, b in zip(ends, ends[1:])]

    def times(self, y: np.ndarray, trans: str = "N") -> np.ndarray:
        row, col = (self.row, self.col) if trans == "N" else (self.col, self.row)
        return np.bincount(row, weights=self.val * y[col], minlength=self.n)

    def diagonal(self) -> np.ndarray:
        on = self.row == self.col
        out = np.zeros(self.n)
        out[self.row[on]] = self.val[on]
        return out

    def transposed(self) -> "Csr":
        return Csr(self.n, self.col, self.row, self.val)

    def part(self, keep: np.ndarray) -> "Csr":
        out = object.__new__(Csr)
        out.n, out.row, out.col, out.val = self.n, self.row[keep], self.col[keep], self.val[keep]
        return out

    def lower(self) -> "Csr":
        return self.part(self.col < self.row)

    def upper(self) -> "Csr":
        return self.part(self.col > self.row)


class Triangle:
    """A strictly lower or upper triangle with its levels: solves y = d * (x - T y)."""

    def __init__(self, t: Csr):
        n = t.n
        waits = np.bincount(t.row, minlength=n)
        start, size = np.searchsorted(t.row, np.arange(n)), waits.copy()
        by_col = np.argsort(t.col, kind="stable")
        first, uses = np.searchsorted(t.col[by_col], np.arange(n)), np.bincount(t.col, minlength=n)
        ready, self.levels = np.flatnonzero(waits == 0), []
        while len(ready):
            at = _spread(start[ready], size[ready])
            self.levels.append((ready, np.repeat(np.arange(len(ready)), size[ready]), t.col[at], t.val[at]))
            hit = t.row[by_col[_spread(first[ready], uses[ready])]]
            waits -= np.bincount(hit, minlength=n)
            ready = np.unique(hit[waits[hit] == 0])
        self.matrix = t

    def solve(self, x: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
        y = np.array(x, float)
        for rows, seg, col, val in self.levels:
            r = y[rows]
            if len(val):
                r -= np.bincount(seg, weights=val * y[col], minlength=len(rows))
            y[rows] = r if d is None else r * d[rows]
        return y

    def transposed(self) -> "Triangle":
        return Triangle(self.matrix.transposed())
