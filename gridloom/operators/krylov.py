"""Krylov methods on any vector space: DataFrames or numpy arrays.  Textbook forms, right preconditioned."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import blas

log = logging.getLogger(__name__)
METHODS = ("CG", "FCG", "CGS", "GCR", "BICG", "BICGSTAB", "BICGSTABL", "RGMRES")


class NumpySpace:
    @staticmethod
    def lin(*terms):
        return sum(a * x for a, x in terms)

    @staticmethod
    def dots(*pairs):
        return [float(x @ y) for x, y in pairs]

    @staticmethod
    def amax(x):
        return float(np.abs(x).max(initial=0.0))


class FrameSpace:
    """Vectors (i, v); every combination is written once, and the products of a step are one job."""

    @staticmethod
    def lin(*terms):
        out = None
        for a, x in terms:
            one = x.select("i", (F.col("v") * float(a)).alias("v"))
            out = one if out is None else out.unionByName(one)
        return blas.cut(out.groupBy("i").agg(F.sum("v").alias("v")))

    @staticmethod
    def dots(*pairs):
        out = None
        for k, (x, y) in enumerate(pairs):
            one = x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w")).alias("d")).select(F.lit(k).alias("k"), "d")
            out = one if out is None else out.union(one)
        got = {r[0]: r[1] or 0.0 for r in out.collect()}  # one number for each pair
        return [got[k] for k in range(len(pairs))]

    @staticmethod
    def amax(x):
        return blas.amax(x)


@dataclass
class Result:
    x: object
    iterations: int
    error: float
    converged: bool
    history: list = field(default_factory=list)


class _Stop:
    """1: normwise backward error (infinity norms), 2: residual over right-hand side, 3: residual over the first."""

    def __init__(self, s, kind, b, eps, itmax, a_norm, trace):
        self.s, self.kind, self.eps, self.itmax, self.a_norm, self.trace, self.history = s, kind, eps, itmax, a_norm, trace, []
        self.b = s.amax(b) if kind == 1 else math.sqrt(s.dots((b, b))[0])
        self.first = None

    def __call__(self, r, x, it) -> bool:
        if self.kind == 1:
            den = self.a_norm * (self.s.amax(x) if x is not None else 0.0) + self.b
            err = self.s.amax(r) / den if den else 0.0
        else:
            n = math.sqrt(max(self.s.dots((r, r))[0], 0.0))
            self.first = n if self.first is None else self.first
            ref = self.b if self.kind == 2 else self.first
            err = n / ref if ref else 0.0
        self.history.append((it, err))
        if self.trace > 0 and it % self.trace == 0:
            log.info("iteration %d: error %.3e, tolerance %.1e", it, err, self.eps)
        return err <= self.eps


def krylov(method, a, b, x0=None, prec=None, space=FrameSpace, eps=1e-6, itmax=500, istop=2, irst=30, a_norm=1.0, trace=-1, a_t=None, prec_t=None) -> Result:
    """Solves A x = b; ``a`` and ``prec`` are functions, ``a_t`` and ``prec_t`` their transposes (BiCG only)."""
    method = method.upper()
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    s, m = space, prec or (lambda v: v)
    zero = s.lin((0.0, b))
    x = zero if x0 is None else x0
    r = b if x0 is None else s.lin((1.0, b), (-1.0, a(x0)))
    stop = _Stop(s, istop, b, eps, itmax, a_norm, trace)
    if stop(r, x, 0):
        return Result(x, 0, stop.history[-1][1], True, stop.history)
    it = 0

    def done(ok):
        return Result(x, it, stop.history[-1][1], ok, stop.history)

    if method in ("CG", "FCG"):
        z = m(r)
        p, rz = z, s.dots((r, z))[0]
        while it < itmax:
            it += 1
            q = a(p)
            pq = s.dots((p, q))[0]
            if pq == 0:
                return done(False)
            alpha = rz / pq
            x, old = s.lin((1.0, x), (alpha, p)), r
            r = s.lin((1.0, r), (-alpha, q))
            if stop(r, x, it):
                return done(True)
            z = m(r)
            new, cross = s.dots((r, z), (old, z))
            beta = (new - (cross if method == "FCG" else 0.0)) / rz
            p, rz = s.lin((1.0, z), (beta, p)), new
        return done(False)
    if method == "GCR":
        ps, qs, qq = [], [], []
        while it < itmax:
            it += 1
            p = m(r)
            q = a(p)
            if ps:
                c = [d / n for d, n in zip(s.dots(*[(q, y) for y in qs]), qq)]
                p = s.lin((1.0, p), *[(-k, y) for k, y in zip(c, ps)])
                q = s.lin((1.0, q), *[(-k, y) for k, y in zip(c, qs)])
            n, rq = s.dots((q, q), (r, q))
            if n == 0:
                return done(False)
            x, r = s.lin((1.0, x), (rq / n, p)), s.lin((1.0, r), (-rq / n, q))
            if stop(r, x, it):
                return done(True)
            if len(ps) >= irst:
                ps, qs, qq = [], [], []
            ps.append(p)
            qs.append(q)
            qq.append(n)
        return done(False)
    if method == "BICG":
        if a_t is None:
            raise ValueError("BICG needs the transposed matrix")
        mt = prec_t or m
        rs, z = r, m(r)
        zs = mt(rs)
        p, ps, rho = z, zs, s.dots((z, rs))[0]
        while it < itmax:
            it += 1
            q, qs = a(p), a_t(ps)
            d = s.dots((q, ps))[0]
            if d == 0:
                return done(False)
            alpha = rho / d
            x, r, rs = s.lin((1.0, x), (alpha, p)), s.lin((1.0, r), (-alpha, q)), s.lin((1.0, rs), (-alpha, qs))
            if stop(r, x, it):
                return done(True)
            z, zs = m(r), mt(rs)
            new = s.dots((z, rs))[0]
            if rho == 0:
                return done(False)
            p, ps, rho = s.lin((1.0, z), (new / rho, p)), s.lin((1.0, zs), (new / rho, ps)), new
        return done(False)
    if method == "CGS":
        rt, p, u = r, r, r
        rho = s.dots((rt, r))[0]
        while it < itmax:
            it += 1
            v = a(m(p))
            d = s.dots((rt, v))[0]
            if d == 0 or rho == 0:
                return done(False)
            alpha = rho / d
            q = s.lin((1.0, u), (-alpha, v))
            w = m(s.lin((1.0, u), (1.0, q)))
            x, r = s.lin((1.0, x), (alpha, w)), s.lin((1.0, r), (-alpha, a(w)))
            if stop(r, x, it):
                return done(True)
            new = s.dots((rt, r))[0]
            beta, rho = new / rho, new
            u = s.lin((1.0, r), (beta, q))
            p = s.lin((1.0, u), (beta, q), (beta * beta, p))
        return done(False)
    if method == "BICGSTAB":
        rt, p = r, r
        rho = s.dots((rt, r))[0]
        while it < itmax:
            it += 1
            ph = m(p)
            v = a(ph)
            d = s.dots((rt, v))[0]
            if d == 0 or rho == 0:
                return done(False)
            alpha = rho / d
            t0 = s.lin((1.0, r), (-alpha, v))
            sh = m(t0)
            t = a(sh)
            tt, ts = s.dots((t, t), (t, t0))
            w = ts / tt if tt else 0.0
            x, r = s.lin((1.0, x), (alpha, ph), (w, sh)), s.lin((1.0, t0), (-w, t))
            if stop(r, x, it):
                return done(True)
            new = s.dots((rt, r))[0]
            if w == 0:
                return done(False)
            beta, rho = new / rho * alpha / w, new
            p = s.lin((1.0, r), (beta, p), (-beta * w, v))
        return done(False)
    if method == "BICGSTABL":
        ell, am = 2, lambda v: a(m(v))
        y, rt, u = zero, r, zero  # x = x0 + M y
        base, rho, alpha, w = x, 1.0, 0.0, 1.0
        while it < itmax:
            it += 1
            rho = -w * rho
            rs, us = [r], [u]
            for j in range(ell):
                new = s.dots((rs[j], rt))[0]
                if rho == 0:
                    return done(False)
                beta, rho = alpha * new / rho, new
                us = [s.lin((1.0, rs[k]), (-beta, us[k])) for k in range(j + 1)]
                us.append(am(us[j]))
                g = s.dots((us[j + 1], rt))[0]
                if g == 0:
                    return done(False)
                alpha = rho / g
                rs = [s.lin((1.0, rs[k]), (-alpha, us[k + 1])) for k in range(j + 1)]
                rs.append(am(rs[j]))
                y = s.lin((1.0, y), (alpha, us[0]))
            gram = s.dots(*[(rs[k], rs[q]) for k in range(1, ell + 1) for q in range(1, ell + 1)], *[(rs[k], rs[0]) for k in range(1, ell + 1)])
            g = np.linalg.lstsq(np.array(gram[: ell * ell]).reshape(ell, ell), np.array(gram[ell * ell :]), rcond=None)[0]
            w = float(g[-1])
            y = s.lin((1.0, y), *[(float(g[k]), rs[k]) for k in range(ell)])
            u = s.lin((1.0, us[0]), *[(-float(g[k]), us[k + 1]) for k in range(ell)])
            r = s.lin((1.0, rs[0]), *[(-float(g[k]), rs[k + 1]) for k in range(ell)])
            x = s.lin((1.0, base), (1.0, m(y)))
            if stop(r, x, it):
                return done(True)
            if w == 0:
                return done(False)
        return done(False)
    while it < itmax:  # RGMRES
        beta = math.sqrt(s.dots((r, r))[0])
        vs, h = [s.lin((1.0 / beta, r))], np.zeros((irst + 1, irst))
        for j in range(irst):
            it += 1
            w = a(m(vs[j]))
            c = s.dots(*[(w, v) for v in vs])
            h[: j + 1, j] = c
            w = s.lin((1.0, w), *[(-k, v) for k, v in zip(c, vs)])
            h[j + 1, j] = math.sqrt(max(s.dots((w, w))[0], 0.0))
            e = np.zeros(j + 2)
            e[0] = beta
            g, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], e, rcond=None)
            err = float(np.linalg.norm(h[: j + 2, : j + 1] @ g - e))
            if err <= eps * (stop.b if istop != 3 else stop.first or beta) or it >= itmax or h[j + 1, j] < 1e-14 * beta:
                break
            vs.append(s.lin((1.0 / h[j + 1, j], w)))
        x = s.lin((1.0, x), (1.0, m(s.lin(*[(float(k), v) for k, v in zip(g, vs)]))))
        r = s.lin((1.0, b), (-1.0, a(x)))
        if stop(r, x, it):
            return done(True)
    return done(False)
