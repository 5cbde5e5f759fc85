"""Sparse direct solution over all blocks: nested dissection and a tree of dense fronts, one Spark stage for each level.

The graph is halved ``depth`` times (``graph_partition``).  An edge between two halves puts its end in the lower half into
the separator of the place in the tree where they part; so every edge joins a tree node with itself or with an ancestor.
From the leaves up, a front gathers the entries of its own unknowns and what its children hand on, eliminates its own
unknowns and hands the Schur complement on its boundary (unknowns of ancestors) to its parent.  A front is one row; fronts
of one level are independent.  A solution goes up the tree with the right-hand side and down again with the unknowns.

A front is dense: the inverse of its pivot block (pivoted by the dense factorisation) and the two coupling blocks.  Its size
is that of a separator, not of the matrix; a front of more than ``MAX_FRONT`` unknowns is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blas
from gridloom.operators.partition import graph_partition
from gridloom.operators.smooth import Smoother
from gridloom.scratch import cut_by

#: Unknowns of a leaf, about, and the most of a front.
LEAF, MAX_FRONT = 150, 10_000
FRONT = "node long, own binary, bnd binary, inv binary, f12 binary, f21 binary, s binary"


def dissection(a: DataFrame, depth: int) -> DataFrame:
    """(i, lev, node): the tree node of each unknown; the root is 1, the children of k are 2 k and 2 k + 1."""
    p = graph_partition(a, 2**depth)
    both = a.where("i <> j").select("i", "j").union(a.where("i <> j").select("j", "i"))
    e = both.join(p, "i").join(p.select(F.col("i").alias("j"), F.col("blk").alias("bj")), "j").where("blk < bj")
    apart = e.groupBy("i").agg(F.min(F.lit(depth - 1) - F.floor(F.log2(F.col("blk").bitwiseXOR(F.col("bj")).cast("double")))).cast("int").alias("sep"))
    lev = F.coalesce("sep", F.lit(depth))
    return p.join(apart, "i", "left").select("i", lev.alias("lev"), F.expr(f"shiftleft(1L, {'coalesce(sep, %d)' % depth}) + shiftright(blk, {depth} - coalesce(sep, {depth}))").alias("node"))


def _numbers(x: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(x, kind)


def eliminated(pdf: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
    """One front: entries (node, i, j, v), where j is null for own unknowns, and the fronts of its children."""
    node = pdf.node.iloc[0] if len(pdf) else below.node.iloc[0]
    own = np.unique(pdf.i[pdf.j.isna()].to_numpy("int64"))
    e = pdf[pdf.j.notna()]
    ei, ej = e.i.to_numpy("int64"), e.j.to_numpy("int64")
    given = [(_numbers(b, np.int64), _numbers(s)) for b, s in zip(below.bnd, below.s)]
    bnd = np.setdiff1d(np.concatenate([ei, ej, *[b for b, _ in given]]), own)
    k, size = len(own), len(own) + len(bnd)
    if size > MAX_FRONT:
        raise ValueError(f"a front of {size} unknowns is too large for a task")
    ids = np.concatenate([own, bnd])
    order = np.argsort(ids)
    at = lambda x: order[np.searchsorted(ids[order], x)]
    f = np.zeros((size, size))
    np.add.at(f, (at(ei), at(ej)), e.v.to_numpy("float64"))
    for b, s in given:
        where = at(b)
        f[np.ix_(where, where)] += s.reshape(len(b), len(b))
    f11, f12, f21 = f[:k, :k], f[:k, k:], f[k:, :k]
    free = ~f11.any(axis=1) & ~f12.any(axis=1)  # empty rows stand for themselves
    f11[free, np.flatnonzero(free)] = 1.0
    inv = np.linalg.inv(f11)
    s = f[k:, k:] - f21 @ (inv @ f12)
    return pd.DataFrame({"node": [node], "own": [own.tobytes()], "bnd": [bnd.tobytes()], "inv": [inv.tobytes()], "f12": [f12.tobytes()], "f21": [f21.tobytes()], "s": [s.tobytes()]})


class Multifrontal(Smoother):
    """A direct solver; ``apply`` gives A^-1 x, or with ``trans`` the inverse of the transpose."""

    def __init__(self, leaf: int = LEAF):
        self.leaf = leaf

    def build(self, a: DataFrame, p: DataFrame | None = None) -> "Multifrontal":
        super().build(a, p)
        n = a.select("i").distinct().count()
        self.depth = max(0, math.ceil(math.log2(max(n, 1) / self.leaf)))
        t = self.tree = blas.cut(dissection(a, self.depth))
        place = lambda lev, node: F.struct(F.col(lev).alias("lev"), F.col(node).alias("node"))
        deeper = F.when(F.col("li") >= F.col("lj"), place("li", "ni")).otherwise(place("lj", "nj"))
        placed = a.join(t.select("i", F.col("lev").alias("li"), F.col("node").alias("ni")), "i").join(t.select(F.col("i").alias("j"), F.col("lev").alias("lj"), F.col("node").alias("nj")), "j")
        e = placed.select(deeper.alias("d"), "i", "j", "v").select("d.lev", "d.node", "i", "j", "v")
        e = blas.cut(e.unionByName(t.select("lev", "node", "i", F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("v"))))
        self.fronts: list[DataFrame] = []
        below = a.sparkSession.createDataFrame([], FRONT)
        for lev in range(self.depth, -1, -1):
            up = below.select((F.shiftright("node", 1)).alias("node"), "bnd", "s")
            made = e.where(F.col("lev") == lev).select("node", "i", "j", "v").groupBy("node").cogroup(up.groupBy("node")).applyInPandas(lambda x, y: eliminated(x, y), FRONT)
            below = blas.cut(made)
            self.fronts.append(below)
        self.fronts.reverse()
        # For the way down: the boundary of every front, and the fronts in buckets of their node.
        buckets = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = lambda pdf: pd.DataFrame({"node": np.repeat(pdf.node.to_numpy(), [len(b) // 8 for b in pdf.bnd]), "i": np.concatenate([np.zeros(0, np.int64), *[_numbers(b, np.int64) for b in pdf.bnd]])})
        self.edges = [blas.cut(f.select("node", "bnd").mapInPandas(lambda it: (ids(x) for x in it), "node long, i long")) for f in self.fronts]
        self.fronts = [cut_by(f.select("node", "own", "bnd", "inv", "f12", "f21"), "node", buckets) for f in self.fronts]
        return self

    def _stage(self, lev: int, values: DataFrame, work, schema: str) -> DataFrame:
        return blas.cut(self.fronts[lev].groupBy("node").cogroup(values.groupBy("node")).applyInPandas(work, schema))

    def apply(self, x: DataFrame, y: DataFrame | None = None, sweeps: int = 1, trans: str = "N") -> DataFrame:
        turned = trans != "N"

        def parts(f):
            own, bnd = _numbers(f.own.iloc[0], np.int64), _numbers(f.bnd.iloc[0], np.int64)
            inv, f12, f21 = (_numbers(f[c].iloc[0]) for c in ("inv", "f12", "f21"))
            inv, f12, f21 = inv.reshape(len(own), len(own)), f12.reshape(len(own), len(bnd)), f21.reshape(len(bnd), len(own))
            return (own, bnd, inv.T, f21.T, f12.T) if turned else (own, bnd, inv, f12, f21)

        def up(f: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            own, bnd, inv, _, f21 = parts(f)
            r = np.zeros(len(own))
            np.add.at(r, np.searchsorted(own, v.i.to_numpy()), v.v.to_numpy())
            u = inv @ r
            return pd.DataFrame({"node": np.full(len(own) + len(bnd), f.node.iloc[0]), "i": np.concatenate([own, bnd]), "v": np.concatenate([u, -(f21 @ u)]), "own": np.arange(len(own) + len(bnd)) < len(own)})

        def down(f: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            own, bnd, inv, f12, _ = parts(f)
            u, b = np.zeros(len(own)), np.zeros(len(bnd))
            mine = v.own.to_numpy(bool)
            u[np.searchsorted(own, v.i.to_numpy()[mine])] = v.v.to_numpy()[mine]
            b[np.searchsorted(bnd, v.i.to_numpy()[~mine])] = v.v.to_numpy()[~mine]
            return pd.DataFrame({"i": own, "v": u - inv @ (f12 @ b)})

        r, half = x.select("i", "v"), []
        for lev in range(self.depth, -1, -1):
            mine = r.join(self.tree.where(F.col("lev") == lev).select("i", "node"), "i").groupBy("node", "i").agg(F.sum("v").alias("v"))
            got = self._stage(lev, mine, up, "node long, i long, v double, own boolean")
            half.append(got.where("own"))
            r = r.union(got.where("not own").select("i", "v"))
        half.reverse()
        out = None
        for lev in range(self.depth + 1):
            known = half[lev]
            if out is not None:
                known = known.unionByName(self.edges[lev].join(out, "i").select("node", "i", "v", F.lit(False).alias("own")))
            one = self._stage(lev, known, down, "i long, v double")
            out = one if out is None else out.union(one)
        return out

    def describe(self):
        return f"sparse direct solver with fronts on {self.depth + 1} levels"

    def dump(self):
        return {f"fronts{k}": f for k, f in enumerate(self.fronts)}

    def size_bytes(self):
        return sum(f.agg(F.sum(F.length("inv") + F.length("f12") + F.length("f21"))).first()[0] or 0 for f in self.fronts)
