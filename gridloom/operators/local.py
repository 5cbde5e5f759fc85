"""Solvers of one block in numpy: factor once, solve many times.  Blocks are sized by the partition (i, blk).

``factor`` gets the block's entries with rows and columns numbered from 0 and returns plain data; ``solve`` gets that
and a right-hand side (and the current guess, for sweeps).
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from gridloom.operators.csr import Csr, Triangle

#: Rows of a block that is factored as one dense matrix; beyond, a direct solver works over all blocks (``direct.py``).
MAX_DENSE = 6000


def rows_of(n, i, j, v):
    """Rows as dicts column -> value, columns in order."""
    rows = [{} for _ in range(n)]
    for a, b, x in sorted(zip(i, j, v)):
        rows[a][b] = rows[a].get(b, 0.0) + x
    return rows


def dense(n, i, j, v):
    if n > MAX_DENSE:
        raise ValueError(f"a block of {n} rows is too large for a direct solver; use more blocks")
    m = np.zeros((n, n))
    np.add.at(m, (np.asarray(i, int), np.asarray(j, int)), np.asarray(v, float))
    return m


def ilu(rows, fill: int = 0, modified: bool = False):
    """Level-of-fill incomplete LU: unit lower rows, reciprocal pivots, strictly upper rows.

    Dropped fill is added to the pivot in the modified variant.
    """
    n = len(rows)
    low, up, piv = [None] * n, [None] * n, np.ones(n)
    levels: list[dict[int, int]] = [None] * n
    for r in range(n):
        w, lev, lost = dict(rows[r]), dict.fromkeys(rows[r], 0), 0.0
        w.setdefault(r, 0.0)
        lev.setdefault(r, 0)
        todo = sorted(c for c in w if c < r)  # a heap: the columns to eliminate
        while todo:
            k = heapq.heappop(todo)
            w[k] *= piv[k]
            for c, x in up[k].items():
                level = lev[k] + levels[k][c] + 1
                if c in w:
                    w[c] -= w[k] * x
                    lev[c] = min(lev[c], level)
                elif level <= fill:
                    w[c], lev[c] = -w[k] * x, level
                    if c < r:
                        heapq.heappush(todo, c)
                else:
                    lost -= w[k] * x
        d = w[r] + (lost if modified else 0.0)
        piv[r] = 1.0 / d if d else 1.0
        low[r] = {c: x for c, x in w.items() if c < r}
        up[r] = {c: x for c, x in sorted(w.items()) if c > r}
        levels[r] = lev
    return low, piv, up


def ilut(rows, fill: int, tol: float):
    """Threshold incomplete LU: entries under ``tol`` times the row norm go, and at most the row's own number plus
    ``fill`` stay on either side."""
    n = len(rows)
    low, up, piv = [None] * n, [None] * n, np.ones(n)
    for r in range(n):
        w = dict(rows[r])
        w.setdefault(r, 0.0)
        bar = tol * math.sqrt(sum(x * x for x in w.values()))
        n_low, n_up = sum(c < r for c in rows[r]), sum(c > r for c in rows[r])
        todo = sorted(c for c in w if c < r)
        while todo:
            k = heapq.heappop(todo)
            w[k] *= piv[k]
            if abs(w[k]) < bar:
                del w[k]
                continue
            for c, x in up[k].items():
                if c < r and c not in w:
                    heapq.heappush(todo, c)
                w[c] = w.get(c, 0.0) - w[k] * x
        piv[r] = 1.0 / w[r] if w[r] else 1.0
        keep = lambda side, m: dict(sorted(sorted(side, key=lambda t: -abs(t[1]))[:m]))
        low[r] = keep([(c, x) for c, x in w.items() if c < r and abs(x) >= bar], n_low + fill)
        up[r] = keep([(c, x) for c, x in w.items() if c > r and abs(x) >= bar], n_up + fill)
    return low, piv, up


def factored(low, piv, up):
    """Rows of incomplete factors as triangles with levels: (L, pivots, U)."""
    return Triangle(Csr.of_rows(low)), piv, Triangle(Csr.of_rows(up))


def lu_apply(f, x, trans="N"):
    """U^-1 D L^-1 x with U = I + D * upper; T solves with the transposes."""
    low, piv, up = f
    if trans == "N":
        return up.solve(low.solve(x), piv)
    return low.transposed().solve(up.transposed().solve(x, piv))


def largest(row: dict[int, float], keep: int, own: int) -> dict[int, float]:
    """The entry ``own`` and the ``keep`` largest others."""
    rest = sorted(((c, x) for c, x in row.items() if c != own), key=lambda t: (-abs(t[1]), t[0]))[:keep]
    return dict(sorted([*rest, (own, row[own])]))


def sparse_inverse(low, fill: int | None, tol: float, more: int | None = None):
    """Rows of the inverse of a unit lower triangle; fill beyond ``fill`` levels or under ``tol`` is dropped, and with
    ``more`` all but so many entries more than the row of the triangle has."""
    out, lev = [], []
    for r in range(len(low)):
        w, ln = {r: 1.0}, {r: 0}
        for c, v in sorted(low[r].items()):
            for k, x in out[c].items():
                level = lev[c][k] + 1
                if fill is None or level <= fill + 1:
                    w[k] = w.get(k, 0.0) - v * x
                    ln[k] = min(ln.get(k, level), level)
        w = {k: x for k, x in w.items() if k == r or abs(x) >= tol}
        out.append(w if more is None else largest(w, len(low[r]) + more, r))
        lev.append(ln)
    return out


def approximate_inverse(f, fill: int | None, tol: float, more: int | None = None):
    """(Z, D, W) with Z D W near the inverse, from the rows of incomplete factors."""
    low, piv, up = f
    w = sparse_inverse(low, fill, tol, more)
    t = [{} for _ in low]  # transpose of the unit upper triangle
    for r, row in enumerate(up):
        for c, v in row.items():
            t[c][r] = v * piv[r]
    z = sparse_inverse(t, fill, tol, more)
    return Csr.of_rows(z), piv, Csr.of_rows(w)


def ainv(rows, tol: float, symmetric: bool = False, stabilised: bool = False, more: int | None = None):
    """Biconjugation: vectors z and w with W^T A Z diagonal; small entries are dropped, and with ``more`` all but so many
    entries more than the matrix has in that row (column) up to the diagonal.

    The left-looking form is used for all variants; the stabilised one takes pivots as z^T A z.  A vector is visited only
    where it meets the one in work: for each column the earlier vectors whose product with A has an entry there are linked.
    """
    n = len(rows)
    cols = [{} for _ in range(n)]
    for r, row in enumerate(rows):
        for c, v in row.items():
            cols[c][r] = v
    sdot = lambda a, b: sum(x * b[k] for k, x in a.items() if k in b) if len(a) <= len(b) else sum(x * a[k] for k, x in b.items() if k in a)

    def conjugated(r, linked, product, along):
        """e_r without its part along the earlier vectors that meet it."""
        a, todo, seen = {r: 1.0}, [], set()

        def meet(c, after):
            for k in linked[c]:
                if k > after and k not in seen:
                    seen.add(k)
                    heapq.heappush(todo, k)

        meet(r, -1)
        while todo:
            k = heapq.heappop(todo)
            p = sdot(product[k], a) / d[k]
            if p:
                for c, x in along[k].items():
                    if c not in a:
                        meet(c, k)
                    a[c] = a.get(c, 0.0) - p * x
        a = {c: x for c, x in a.items() if c == r or abs(x) >= tol}
        return a if more is None else largest(a, more + sum(c < r for c in rows[r]), r)

    z, w, d = [], [], np.ones(n)
    wa, za = [], []  # w_k^T A and A z_k
    meets_z, meets_w = [[] for _ in range(n)], [[] for _ in range(n)]
    for r in range(n):
        a = conjugated(r, meets_z, wa, z)
        b = a if symmetric else conjugated(r, meets_w, za, w)
        z.append(a)
        w.append(b)
        wa.append(rows_times(b, rows))
        pivot = sdot(wa[r], a) if stabilised else sdot(rows[r], a)
        d[r] = pivot or 1.0
        for c in wa[r]:
            meets_z[c].append(r)
        if not symmetric:
            za.append(rows_times(a, cols))
            for c in za[r]:
                meets_w[c].append(r)
    return Csr.of_rows(z), 1.0 / d, Csr.of_rows(w)


def rows_times(v: dict, rows) -> dict:
    """v^T A."""
    out: dict[int, float] = {}
    for k, x in v.items():
        for c, y in rows[k].items():
            out[c] = out.get(c, 0.0) + x * y
    return out


def inverse_apply(f, x, trans="N"):
    """Z D W x; T applies W^T D Z^T.  Row k of the stored Z is column k of Z."""
    z, d, w = f
    if trans != "N":
        z, w = w, z
    return z.times(w.times(np.asarray(x, float)) * d, "T")


def diagonal_update(f, shift):
    """Factors for A + diag(shift) without new factors: 1/d grows by the diagonal of W diag(shift) Z."""
    z, d, w = f
    _, a, b = np.intersect1d(w.row * w.n + w.col, z.row * z.n + z.col, return_indices=True)
    add = np.bincount(w.row[a], weights=w.val[a] * np.asarray(shift, float)[w.col[a]] * z.val[b], minlength=w.n)
    return z, 1.0 / (1.0 / d + add), w


class Block:
    """A local solver by keyword: ``factor`` the entries, ``solve`` for a right-hand side from a guess."""

    def __init__(self, kind: str, fill: int = 0, tol: float = 0.0, sweeps: int = 1, inv_fill: int = 0, variant: str = "LLK", method: str = "BICGSTAB", itmax: int = 40, eps: float = 1e-6, istop: int = 2, irst: int = 30, sub_solve: str = "ILU", kprec: str = "BJAC", krm_fill: int = 1, trace: int = -1, inv_tol: float | None = None):
        self.kind, self.fill, self.tol, self.sweeps, self.inv_fill, self.variant = kind.upper(), fill, tol, sweeps, inv_fill, variant.upper()
        self.method, self.itmax, self.eps, self.istop, self.irst = method, itmax, eps, istop, irst
        self.inv_tol = tol if inv_tol is None else inv_tol
        self.krm_fill, self.sub_solve, self.kprec, self.trace = krm_fill, sub_solve.upper(), kprec.upper(), trace

    def inner(self) -> "Block":
        """What preconditions the inner Krylov method: a point method or, for block Jacobi, the solver of the block."""
        kind = {"NONE": "NONE", "NOPREC": "NONE", "BJAC": self.sub_solve, "L1-BJAC": self.sub_solve, "AS": self.sub_solve, "ML": self.sub_solve, "JAC": "DIAG"}.get(self.kprec, self.kprec)
        return Block("ILU" if kind == "KRM" else kind, fill=self.krm_fill, tol=self.tol, inv_fill=self.inv_fill)

    def factor(self, n, i, j, v):
        k, m = self.kind, Csr(n, i, j, v)
        if k in ("NONE", "ID"):
            return n
        if k in ("DIAG", "JACOBI", "L1-DIAG", "L1-JACOBI"):
            d = m.diagonal()
            if k.startswith("L1"):
                off = m.part(m.row != m.col)
                d = d + np.bincount(off.row, weights=np.abs(off.val), minlength=n)
            return m, 1.0 / np.where(d == 0, 1.0, d)
        if k in ("GS", "FGS", "FWGS", "BGS", "BWGS"):
            d = m.diagonal()
            return Triangle(m.lower()), 1.0 / np.where(d == 0, 1.0, d), Triangle(m.upper())
        if k in ("ILU", "MILU", "ILUT"):
            return factored(*(ilut(m.rows(), self.fill, self.tol) if k == "ILUT" else ilu(m.rows(), self.fill, k == "MILU")))
        if k == "INVK":
            return approximate_inverse(ilu(m.rows(), self.fill), self.inv_fill, 0.0)
        if k == "INVT":
            return approximate_inverse(ilut(m.rows(), self.fill, self.tol), None, self.inv_tol, self.inv_fill or None)
        if k == "AINV":
            return ainv(m.rows(), self.tol, self.variant == "SYM-LLK", self.variant == "STAB-LLK", self.inv_fill or None)
        if k in ("LU", "SLU", "UMF", "SLUDIST", "MUMPS"):
            full = dense(n, i, j, v)
            zero = ~full.any(axis=1)
            full[zero, np.flatnonzero(zero)] = 1.0
            return np.linalg.inv(full)
        if k == "KRM":
            return m, self.inner().factor(n, i, j, v)
        raise ValueError(f"unknown local solver {self.kind}")

    def solve(self, f, x, y=None, trans="N"):
        k, x = self.kind, np.asarray(x, float)
        if k in ("NONE", "ID"):
            return x
        if k in ("DIAG", "L1-DIAG"):
            return f[1] * x
        if k in ("JACOBI", "L1-JACOBI"):
            m, d = f
            y = np.zeros(len(x)) if y is None else np.array(y, float)
            for _ in range(self.sweeps):
                y = y + d * (x - m.times(y, trans))
            return y
        if k in ("GS", "FGS", "FWGS", "BGS", "BWGS"):
            # The transpose of a sweep goes over the transposed rows the other way round.
            low, d, up = f if trans == "N" else (f[2].transposed(), f[1], f[0].transposed())
            forward = (k in ("GS", "FGS", "FWGS")) == (trans == "N")
            new, old = (low, up) if forward else (up, low)
            y = np.zeros(len(x)) if y is None else np.array(y, float)
            for _ in range(self.sweeps):
                y = new.solve(x - old.matrix.times(y), d)
            return y
        if k in ("ILU", "MILU", "ILUT"):
            return lu_apply(f, x, trans)
        if k in ("INVK", "INVT", "AINV"):
            return inverse_apply(f, x, trans)
        if k == "KRM":
            from gridloom.operators.krylov import NumpySpace, krylov

            m, pre = f
            inner, other = self.inner(), "T" if trans == "N" else "N"
            norm = float(np.bincount(m.row, weights=np.abs(m.val), minlength=1).max(initial=1.0)) if len(m.val) else 1.0
            return krylov(self.method, lambda u: m.times(u, trans), x, prec=lambda u: inner.solve(pre, u, None, trans), space=NumpySpace, eps=self.eps, itmax=self.itmax, istop=self.istop, irst=self.irst, a_norm=norm, trace=self.trace, a_t=lambda u: m.times(u, other), prec_t=lambda u: inner.solve(pre, u, None, other)).x
        return (f if trans == "N" else f.T) @ x

    def entries(self, f):
        """(kind, row, col, value) arrays of what was computed: l, d and u of triangles, z, d and w of inverses, m of a
        dense one; l is unit, d has pivots or diagonals, u is strictly upper."""
        k, out = self.kind, []
        put = lambda kind, m: out.append((np.full(len(m.val), kind), m.row, m.col, m.val))
        dia = lambda kind, d: put(kind, Csr(len(d), np.arange(len(d)), np.arange(len(d)), d))
        if k in ("ILU", "MILU", "ILUT", "GS", "FGS", "FWGS", "BGS", "BWGS"):
            put("l", f[0].matrix)
            dia("d", 1.0 / f[1])
            put("u", f[2].matrix)
        elif k in ("INVK", "INVT", "AINV"):
            put("z", f[0].transposed())
            dia("d", f[1])
            put("w", f[2])
        elif k in ("DIAG", "JACOBI", "L1-DIAG", "L1-JACOBI"):
            dia("d", 1.0 / f[1])
        elif isinstance(f, np.ndarray):
            i, j = np.nonzero(f)
            put("m", Csr(len(f), i, j, f[i, j]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, str), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
