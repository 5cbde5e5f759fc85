"""Smoothers: y is improved for A y = x.  Block work is grouped by the explicit partition (i, blk)."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blas
from gridloom.operators.local import Block
from gridloom.scratch import cut_by


class Smoother(ABC):
    """``build`` once for a matrix and a partition, then ``apply``; users may supply their own."""

    def build(self, a: DataFrame, p: DataFrame) -> "Smoother":
        self.a, self.p = a, p
        return self

    @abstractmethod
    def apply(self, x: DataFrame, y: DataFrame | None = None, sweeps: int = 1, trans: str = "N") -> DataFrame: ...

    def describe(self) -> str:
        return type(self).__name__

    def dump(self) -> dict[str, DataFrame]:
        return {}

    def size_bytes(self) -> int:
        """Bytes of the numbers that ``build`` made: 24 for an entry (i, j, v), 16 for an element (i, v)."""
        return sum((24 if "j" in d.columns else 16) * d.count() for d in self.dump().values())


class Identity(Smoother):
    def apply(self, x, y=None, sweeps=1, trans="N"):
        return x


class Jacobi(Smoother):
    """Point Jacobi; with ``l1`` the diagonal is that plus the absolute off-diagonal row sum."""

    def __init__(self, l1: bool = False):
        self.l1 = l1

    def build(self, a, p):
        super().build(a, p)
        if self.l1 or p is None:
            d = blas.l1_diag(a) if self.l1 else blas.diag(a)
        else:  # the partition names the rows
            d = p.select("i").join(blas.given_diag(a), "i", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
        self.d = blas.cut(d.withColumn("v", blas.reciprocal(F.col("v"))))
        return self

    def apply(self, x, y=None, sweeps=1, trans="N"):
        for _ in range(sweeps):
            if y is None:  # a zero guess needs no product
                y = blas.mlt(self.d, x)
            else:
                y = blas.axpby(1.0, y, 1.0, blas.mlt(self.d, blas.axpby(1.0, x, -1.0, blas.spmv(self.a, y, trans=trans))))
            y = blas.cut(y)
        return y

    def dump(self):
        return {"d": self.d}


class BlockJacobi(Smoother):
    """y <- B^-1 (x - N y): B are the diagonal blocks, solved by a local solver, and N is the rest.

    With ``l1`` the absolute off-block row sums move to the diagonal of B.  Blocks are factored once; a factor is one
    row.  Without off-block entries one solve is all (but for solvers that sweep from a guess).
    """

    def __init__(self, solver: Block, l1: bool = False):
        self.solver, self.l1 = solver, l1

    def build(self, a, p):
        super().build(a, p)
        self.diagonal = None
        if type(self.solver) is Block and self.solver.kind == "DIAG" and not self.l1:  # a vector: no block is gathered
            d = p.select("i", "blk").join(a.where("i = j").groupBy("i").agg(F.sum("v").alias("d")), "i", "left")
            self.diagonal = blas.cut(d.select("blk", "i", blas.reciprocal(F.coalesce("d", F.lit(0.0))).alias("d")))
            self.off, self.inverse = blas.cut(blas.block_clip(a, p, inside=False)), None
            self.coupled = self.off.limit(1).count() > 0
            return self
        e = blas.cut(blas.block_of(a, p))
        inside, off = e.where("bi = bj").select(F.col("bi").alias("blk"), "i", "j", "v"), e.where("bi <> bj").select("i", "j", "v")
        if self.l1:
            s = e.where("bi <> bj").groupBy("bi", "i").agg(F.sum(F.abs("v")).alias("v"))
            inside = inside.union(s.select(F.col("bi").alias("blk"), "i", F.col("i").alias("j"), "v")).groupBy("blk", "i", "j").agg(F.sum("v").alias("v"))
            off = off.union(s.select("i", F.col("i").alias("j"), -F.col("v")))
        self.off = blas.cut(off)
        self.coupled = self.off.limit(1).count() > 0
        self.packs = packs(p, self.solver)
        self.factors = factor_blocks(inside, p, self.solver, self.packs)
        # Approximate inverses are matrices: they are applied by products, without Python.
        self.inverse = None
        if self.solver.kind in ("INVK", "INVT", "AINV"):
            e = blas.cut(factor_entries(self.factors, self.solver))
            self.inverse = [e.where(F.col("kind") == k).select("i", "j", "v") for k in "zdw"]
        return self

    def apply(self, x, y=None, sweeps=1, trans="N"):
        if self.diagonal is not None:
            for _ in range(sweeps):
                rhs = x if y is None or not self.coupled else blas.axpby(1.0, x, -1.0, blas.spmv(self.off, y, trans=trans))
                y = blas.cut(self.diagonal.join(rhs, "i", "left").select("i", (F.coalesce("v", F.lit(0.0)) * F.col("d")).alias("v")))
            return y
        if self.inverse:
            z, d, w = self.inverse if trans == "N" else (blas.transpose(m) for m in reversed(self.inverse))
            for _ in range(sweeps):
                rhs = x if y is None or not self.coupled else blas.axpby(1.0, x, -1.0, blas.spmv(self.off, y, trans=trans))
                y = blas.cut(blas.spmv(z, blas.spmv(d, blas.spmv(w, rhs))))
            return y
        for _ in range(sweeps):
            rhs = x if y is None or not self.coupled else blas.axpby(1.0, x, -1.0, blas.spmv(self.off, y, trans=trans))
            y = blas.cut(solve_blocks(self.factors, self.p, rhs, y, self.solver, trans, size=self.packs))
        return y

    def describe(self):
        return f"{'l1-' if self.l1 else ''}block Jacobi with {self.solver.kind}"

    def dump(self):
        if self.diagonal is not None:
            return {"factors": self.diagonal.select("blk", F.lit("d").alias("kind"), "i", F.col("i").alias("j"), (1.0 / F.col("d")).alias("v")), "off": self.off}
        return {"factors": factor_entries(self.factors, self.solver), "off": self.off}


#: Rows, about, of the small blocks that are factored and solved together, and the solvers that do the same on such a pack:
#: its matrix is block diagonal, and they fill and drop by rows.
PACK = 4096
BY_ROWS = ("NONE", "ID", "DIAG", "JACOBI", "L1-DIAG", "L1-JACOBI", "GS", "FGS", "FWGS", "BGS", "BWGS", "ILU", "MILU", "ILUT", "INVK", "INVT", "AINV")


def packs(p: DataFrame, solver: Block) -> int:
    """Numbers of blocks in a pack: as many of the largest block as ``PACK`` rows hold."""
    if type(solver) is not Block or solver.kind not in BY_ROWS:
        return 1
    largest = p.groupBy("blk").count().agg(F.max("count")).first()[0] or PACK
    return max(1, PACK // largest)


def pack_of(size: int):
    return F.floor(F.col("blk") / size).cast("int")


def factor_blocks(inside: DataFrame, p: DataFrame, solver: Block, size: int = 1) -> DataFrame:
    """(blk, factor) with the nodes of the block, the blocks of these and the pickled factor, in buckets of blk: sweeps leave
    them in place.  With ``size`` so many consecutive blocks are one row, named by their pack.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pack, pdf = pdf.blk.iloc[0], pdf[pdf.i.notna()]
        ids, first = np.unique(pdf.i.astype("int64"), return_index=True)
        e = pdf[pdf.j.notna()]
        f = solver.factor(len(ids), np.searchsorted(ids, e.i.astype("int64")).tolist(), np.searchsorted(ids, e.j.astype("int64")).tolist(), e.v.tolist())
        return pd.DataFrame({"blk": [pack], "factor": [pickle.dumps((ids, pdf.own.to_numpy("int32")[first], f))]}).astype({"blk": "int32"})

    nodes = p.select("blk", "i", F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("v"))
    made = inside.unionByName(nodes).select(pack_of(size).alias("blk"), F.col("blk").alias("own"), "i", "j", "v").groupBy("blk").applyInPandas(run, "blk int, factor binary")
    return cut_by(made, "blk", int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def factor_entries(factors: DataFrame, solver: Block) -> DataFrame:
    """(blk, kind, i, j, v): the factors of all blocks as entries between nodes (``Block.entries``)."""

    def run(it):
        for pdf in it:
            for raw in pdf.factor:
                ids, own, f = pickle.loads(raw)
                kind, i, j, v = solver.entries(f)
                yield pd.DataFrame({"blk": own[i], "kind": kind, "i": ids[i], "j": ids[j], "v": v})

    return factors.mapInPandas(run, "blk int, kind string, i long, j long, v double")


def solve_blocks(factors: DataFrame, p: DataFrame, x: DataFrame, y: DataFrame | None, solver: Block, trans: str = "N", keyed: bool = False, size: int = 1) -> DataFrame:
    """(i, v) of the block solves; with ``keyed`` x has its own blk and the result keeps it.  ``size`` as in ``factor_blocks``."""
    p = p if keyed else p.select("i", pack_of(size).alias("blk"))
    xs = x if keyed else x.join(p, "i").select("blk", "i", "v")
    xs = xs.select("blk", "i", "v", F.lit(0).alias("which"))
    if y is not None:
        xs = xs.union(y.join(p, "i").select("blk", "i", "v", F.lit(1).alias("which")))

    def run(fdf: pd.DataFrame, xdf: pd.DataFrame) -> pd.DataFrame:
        if not len(fdf):
            return pd.DataFrame({"blk": [], "i": [], "v": []}).astype({"blk": "int32", "i": "int64", "v": "float64"})
        ids, _, f = pickle.loads(fdf.factor.iloc[0])
        vec = np.zeros((2, len(ids)))
        np.add.at(vec, (xdf.which.to_numpy(), np.searchsorted(ids, xdf.i.to_numpy())), xdf.v.to_numpy())
        out = solver.solve(f, vec[0], vec[1] if (xdf.which == 1).any() else None, trans)
        return pd.DataFrame({"blk": np.full(len(ids), fdf.blk.iloc[0], "int32"), "i": ids, "v": out})

    out = factors.groupBy("blk").cogroup(xs.groupBy("blk")).applyInPandas(run, "blk int, i long, v double")
    return out if keyed else out.select("i", "v")


class Schwarz(Smoother):
    """Additive Schwarz: blocks with ``overlap`` layers of neighbours, solved locally and combined.

    ``restr`` HALO takes the right-hand side on the overlap, NONE takes zero there; ``prol`` SUM or AVG combines the
    copies, NONE keeps the owner's (with HALO: restricted additive Schwarz).
    """

    def __init__(self, solver: Block, overlap: int = 1, restr: str = "HALO", prol: str = "SUM"):
        self.solver, self.overlap, self.restr, self.prol = solver, overlap, restr.upper(), prol.upper()

    def build(self, a, p):
        super().build(a, p)
        self.own = blas.cut(blas.overlap(a, p, self.overlap))
        inside = self.own.join(a, "i").join(self.own.select("blk", F.col("i").alias("j")), ["blk", "j"]).select("blk", "i", "j", "v")
        self.factors = factor_blocks(inside, self.own.select("i", "blk"), self.solver)
        return self

    def apply(self, x, y=None, sweeps=1, trans="N"):
        restr, prol = (self.restr, self.prol) if trans == "N" else (self.restr if self.prol != "NONE" else "NONE", self.prol if self.restr != "NONE" else "NONE")
        for k in range(sweeps):
            rhs = x if y is None else blas.axpby(1.0, x, -1.0, blas.spmv(self.a, y, trans=trans))
            xs = rhs.join(self.p, "i").select("blk", "i", "v") if restr == "NONE" else self.own.join(rhs, "i").select("blk", "i", "v")
            z = solve_blocks(self.factors, self.p, xs, None, self.solver, trans, keyed=True)
            if prol == "NONE":
                z = z.join(self.p, ["blk", "i"]).select("i", "v")
            else:
                z = blas.overlap_reduce(z, prol)
            y = blas.cut(z if y is None else blas.axpby(1.0, y, 1.0, z))
        return y

    def describe(self):
        return f"additive Schwarz (overlap {self.overlap}, {self.restr}, {self.prol}) with {self.solver.kind}"

    def dump(self):
        return {"factors": factor_entries(self.factors, self.solver)}


class Converged(Smoother):
    """Sweeps of another smoother that stop at a residual tolerance, looked at every ``check`` sweeps."""

    def __init__(self, inner: Smoother, tol: float, check: int = 1):
        self.inner, self.tol, self.check, self.trace = inner, tol, check, []

    def build(self, a, p):
        super().build(a, p)
        self.inner.build(a, p)
        return self

    def apply(self, x, y=None, sweeps=1, trans="N"):
        norm = blas.nrm2(x) or 1.0
        for k in range(1, sweeps + 1):
            y = self.inner.apply(x, y, 1, trans)
            if k % self.check == 0:
                err = blas.nrm2(blas.axpby(1.0, x, -1.0, blas.spmv(self.a, y, trans=trans))) / norm
                self.trace.append((k, err))
                if err <= self.tol:
                    break
        return y


#: Local solver of each smoother keyword that is a block Jacobi carrier: (pre, post, l1).
CARRIERS = {"GS": ("FWGS", "FWGS", False), "FWGS": ("FWGS", "FWGS", False), "BWGS": ("BWGS", "BWGS", False), "FBGS": ("FWGS", "BWGS", False), "L1-GS": ("FWGS", "FWGS", True), "L1-FWGS": ("FWGS", "FWGS", True), "L1-BWGS": ("BWGS", "BWGS", True), "L1-FBGS": ("FWGS", "BWGS", True)}


def make(kind: str, post: bool = False, sub: str | None = None, **options) -> Smoother:
    """The smoother that a keyword names; ``sub`` is the local solver of the block smoothers."""
    kind = kind.upper()
    schwarz = {k: options.pop(k) for k in ("overlap", "restr", "prol") if k in options}
    if kind in ("NONE", "NOPREC"):
        return Identity()
    if kind in ("JAC", "DIAG", "JACOBI"):
        return Jacobi()
    if kind in ("L1-DIAG", "L1-JACOBI"):
        return Jacobi(l1=True)
    if kind in CARRIERS:
        pre, back, l1 = CARRIERS[kind]
        return BlockJacobi(Block(back if post else pre, **options), l1)
    if kind in ("BJAC", "L1-BJAC"):
        return BlockJacobi(Block(sub or "ILU", **options), kind.startswith("L1"))
    if kind == "AS":
        return Schwarz(Block(sub or "ILU", **options), **schwarz)
    raise ValueError(f"unknown smoother {kind}")
