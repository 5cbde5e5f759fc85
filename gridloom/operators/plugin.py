"""An example of a solver that a user supplies: incomplete LU without fill on dense rows, handed to any block smoother."""

from __future__ import annotations

import numpy as np

from gridloom.operators.local import Block


class TriangularLU(Block):
    """``Preconditioner.set(TriangularLU())`` or ``BlockJacobi(TriangularLU())``; a block must fit densely in a task."""

    def __init__(self):
        super().__init__("TLU")

    def factor(self, n, i, j, v):
        f = np.zeros((n, n))
        np.add.at(f, (np.asarray(i, int), np.asarray(j, int)), np.asarray(v, float))
        keep = f != 0
        for r in range(1, n):
            for k in np.flatnonzero(keep[r, :r]):
                f[r, k] /= f[k, k]
                later = keep[r] & (np.arange(n) > k)
                f[r, later] -= f[r, k] * f[k, later]
        return f

    def solve(self, f, x, y=None, trans="N"):
        m, n = (f, len(f)) if trans == "N" else (f.T, len(f))
        unit_low = trans == "N"
        y = np.array(x, float)
        for r in range(n):
            y[r] -= m[r, :r] @ y[:r]
            if not unit_low:
                y[r] /= m[r, r]
        for r in range(n - 1, -1, -1):
            y[r] -= m[r, r + 1 :] @ y[r + 1 :]
            if unit_low:
                y[r] /= m[r, r]
        return y
