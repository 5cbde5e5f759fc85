"""The configured preconditioner: ``Preconditioner(kind).set(...).build(A).apply(v)`` and ``solve``."""

from __future__ import annotations

import copy
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blas
from gridloom.operators.aggregate import Aggregator, Coupled, Decoupled, rap, smoothed
from gridloom.operators.graph import FOLD, omega
from gridloom.operators.krylov import FrameSpace, Result, krylov
from gridloom.operators.direct import Multifrontal
from gridloom.operators.local import Block
from gridloom.operators.smooth import BlockJacobi, Converged, Jacobi, Smoother, make
from gridloom.sources.generators import blocks

KINDS = ("NONE", "NOPREC", "JAC", "DIAG", "JACOBI", "L1-DIAG", "L1-JACOBI", "GS", "FWGS", "BWGS", "FBGS", "BJAC", "L1-BJAC", "AS", "ML")
SMOOTHERS = (*KINDS[:-1], "L1-GS", "L1-FWGS", "L1-BWGS", "L1-FBGS")
SOLVERS = ("NONE", "ID", "DIAG", "L1-DIAG", "JACOBI", "L1-JACOBI", "GS", "FGS", "FWGS", "BGS", "BWGS", "ILU", "MILU", "ILUT", "INVK", "INVT", "AINV", "SLU", "UMF", "SLUDIST", "MUMPS", "KRM")
DIRECT = ("SLU", "UMF", "SLUDIST", "MUMPS", "LU")

#: Option keys: default and what is legal (a tuple of keywords, or a predicate).  An illegal value warns and resets.
OPTIONS = {
    "ML_CYCLE": ("VCYCLE", ("ADD", "MULT", "VCYCLE", "WCYCLE", "KCYCLE", "KCYCLESYM")),
    "OUTER_SWEEPS": (1, lambda v: v >= 1),
    "SMOOTHER_SWEEPS": (1, lambda v: v >= 0),
    "MIN_COARSE_SIZE": (-1, lambda v: True),
    "MIN_COARSE_SIZE_PER_PROCESS": (-1, lambda v: True),
    "MIN_CR_RATIO": (1.5, lambda v: v > 1),
    "MAX_LEVS": (20, lambda v: v >= 1),
    "PAR_AGGR_ALG": ("DEC", ("DEC", "SYMDEC", "COUPLED")),
    "AGGR_TYPE": ("SOC1", ("SOC1", "SOC2", "MATCHBOXP")),
    "AGGR_ORD": ("NATURAL", ("NATURAL", "DEGREE", "HASHED")),
    "AGGR_PROL": ("SMOOTHED", ("UNSMOOTHED", "SMOOTHED")),
    "AGGR_FILTER": ("NOFILTER", ("NOFILTER", "FILTER")),
    "AGGR_THRESH": (0.01, lambda v: 0 <= v <= 1),
    "AGGR_OMEGA_ALG": ("EIG_EST", ("EIG_EST", "USER_CHOICE")),
    "AGGR_EIG": ("A_NORMI", ("A_NORMI",)),
    "AGGR_OMEGA_VAL": (0.0, lambda v: 0 <= v <= 2),
    "AGGR_CLEAN_ZEROS": (True, lambda v: True),
    "AGGR_SIZE": (2, lambda v: v >= 2),
    "SMOOTHER_TYPE": ("FBGS", SMOOTHERS),
    "SUB_SOLVE": ("ILU", SOLVERS),
    "SUB_FILLIN": (0, lambda v: v >= 0),
    "SUB_ILUTHRS": (0.0, lambda v: v >= 0),
    "INV_FILLIN": (0, lambda v: v >= 0),
    "INV_THRESH": (-1.0, lambda v: True),
    "REMAP_ROWS": (0, lambda v: v >= 0),
    "SOLVER_SWEEPS": (1, lambda v: v >= 1),
    "SOLVER_EPS": (0.0, lambda v: v >= 0),
    "AINV_ALG": ("LLK", ("LLK", "STAB-LLK", "SYM-LLK", "MLK")),
    "SUB_OVR": (1, lambda v: v >= 0),
    "SUB_RESTR": ("HALO", ("HALO", "NONE")),
    "SUB_PROL": ("SUM", ("SUM", "AVG", "NONE")),
    "COARSE_SOLVE": ("LU", (*SOLVERS, "BJAC", "L1-BJAC", "LU")),
    "COARSE_SUBSOLVE": ("ILU", SOLVERS),
    "COARSE_MAT": ("DIST", ("DIST", "REPL")),
    "COARSE_SWEEPS": (10, lambda v: v >= 1),
    "COARSE_FILLIN": (0, lambda v: v >= 0),
    "COARSE_ILUTHRS": (0.0, lambda v: v >= 0),
    "COARSE_INVFILL": (0, lambda v: v >= 0),
    "SMOOTHER_STOP": (False, lambda v: True),
    "SMOOTHER_TRACE": (False, lambda v: True),
    "SMOOTHER_ITRACE": (1, lambda v: True),
    "SMOOTHER_RESIDUAL": (1, lambda v: v >= 1),
    "SMOOTHER_STOPTOL": (0.0, lambda v: v >= 0),
    "BJAC_STOP": (False, lambda v: True),
    "BJAC_TRACE": (False, lambda v: True),
    "BJAC_ITRACE": (1, lambda v: True),
    "BJAC_RESCHECK": (1, lambda v: v >= 1),
    "BJAC_STOPTOL": (0.0, lambda v: v >= 0),
    "KRM_METHOD": ("BICGSTAB", ("CG", "FCG", "CGS", "GCR", "BICG", "BICGSTAB", "BICGSTABL", "RGMRES")),
    "KRM_KPREC": ("BJAC", KINDS),
    "KRM_SUB_SOLVE": ("ILU", SOLVERS),
    "KRM_FILLIN": (1, lambda v: v >= 0),
    "KRM_IRST": (30, lambda v: v >= 1),
    "KRM_ISTOPC": (2, (1, 2, 3)),
    "KRM_ITMAX": (40, lambda v: v >= 1),
    "KRM_ITRACE": (-1, lambda v: True),
    "KRM_EPS": (1e-6, lambda v: v > 0),
    "KRM_GLOBAL": (False, lambda v: True),
    "MUMPS_LOC_GLOB": ("LOCAL", ("LOCAL", "GLOBAL")),
    "MUMPS_PRINT_ERR": (0, lambda v: True),
    "MUMPS_SYM": (0, lambda v: True),
    "MUMPS_IPAR_ENTRY": (0, lambda v: True),
    "MUMPS_RPAR_ENTRY": (0.0, lambda v: True),
    "PRMC_MATCH_ALG": ("MATCHBOXP", ("MATCHBOXP",)),
    "PRMC_SWEEPS": (1, lambda v: v >= 1),
    "PRMC_W_SIZE": (0, lambda v: True),
    "PRMC_REPRODUCIBLE_MATCHING": (True, lambda v: True),
    "PRMC_NEED_SYMMETRIZE": (False, lambda v: True),
    "PRMC_UNSMOOTHED_HIERARCHY": (False, lambda v: True),
}


#: Keys that are taken for compatibility and change nothing here; setting one warns.  The direct solver is one dense
#: factorisation, matching is always reproducible, the largest row sum is the only estimate, and traces are kept anyway.
NO_EFFECT = ("AGGR_EIG", "SOLVER_EPS", "SMOOTHER_TRACE", "SMOOTHER_ITRACE", "BJAC_TRACE", "BJAC_ITRACE", "MUMPS_LOC_GLOB", "MUMPS_PRINT_ERR", "MUMPS_SYM", "MUMPS_IPAR_ENTRY", "MUMPS_RPAR_ENTRY", "PRMC_MATCH_ALG", "PRMC_W_SIZE", "PRMC_REPRODUCIBLE_MATCHING")
#: Rows of a block where the number of blocks is not given, rows up to which a coarse matrix is one dense factor, and the
#: most rows of a matrix that is replicated, which makes it one block of one task.
BLOCK_ROWS, DENSE, MAX_REPLICATED = 4000, 1500, 50_000


def legal(key: str, value):
    """The value if it is legal, else the default with a warning; keywords are folded to upper case."""
    default, rule = OPTIONS[key]
    if isinstance(default, str) and isinstance(value, str):
        value = value.upper()
    try:
        ok = value in rule if isinstance(rule, tuple) else bool(rule(value))
    except TypeError:
        ok = False
    if not ok:
        warnings.warn(f"illegal {key} {value!r}; {default!r} is used", stacklevel=3)
        return default
    return value


class Parameters(dict):
    """Option values with the defaults; the aggregators read the ones they need as attributes."""

    def get_option(self, key):
        return self.get(key, OPTIONS[key][0])

    aggr_thresh = property(lambda self: self.get_option("AGGR_THRESH"))
    aggr_ord = property(lambda self: self.get_option("AGGR_ORD"))
    aggr_type = property(lambda self: "SOC2" if self.get_option("AGGR_TYPE") == "SOC2" else "SOC1")


@dataclass
class Level:
    a: DataFrame
    p: DataFrame
    n: int
    nnz: int
    parms: Parameters
    prol: DataFrame | None = None
    restr: DataFrame | None = None
    tprol: DataFrame | None = None
    pre: Smoother | None = None
    post: Smoother | None = None
    ratio: float = 0.0
    extra: dict = field(default_factory=dict)


class GlobalKrylov(Smoother):
    """Inner Krylov solve on the whole level with a block Jacobi preconditioner."""

    def __init__(self, method, itmax, eps, istop, irst, fill):
        self.args, self.fill = (method, itmax, eps, istop, irst), fill

    def build(self, a, p):
        super().build(a, p)
        self.inner = BlockJacobi(Block("ILU", fill=self.fill)).build(a, p)
        return self

    def apply(self, x, y=None, sweeps=1, trans="N"):
        method, itmax, eps, istop, irst = self.args
        got = krylov(method, lambda v: blas.spmv(self.a, v, trans=trans), x, y, lambda v: self.inner.apply(v, trans=trans), FrameSpace, eps, itmax, istop, irst)
        if not got.converged:
            warnings.warn(f"inner {method} stopped after {got.iterations} steps with error {got.error:.1e} (tolerance {eps:.1e})", stacklevel=2)
        return got.x


class Preconditioner:
    """A single smoother or a multilevel hierarchy."""

    def __init__(self, kind: str = "ML"):
        if kind.upper() not in KINDS:
            raise ValueError(f"unknown preconditioner {kind!r}")
        self.kind, self.parms, self.at, self.levels, self.objects = kind.upper(), Parameters(), {}, [], {}

    def set(self, what, value=None, ilev: int | None = None, ilmax: int | None = None, pos: str | None = None) -> "Preconditioner":
        """An option (keyword, value) for all levels or for levels ``ilev`` to ``ilmax`` (1 is the finest), for the
        PRE or POST smoother; or an object: Smoother, Block or Aggregator.  Unknown keywords and those without effect warn."""
        levels = [None] if ilev is None else range(ilev, (ilmax or ilev) + 1)
        if not isinstance(what, str):
            role = "aggregator" if isinstance(what, Aggregator) else "solver" if isinstance(what, Block) else "smoother"
            for k in levels:
                self.objects[role, k, (pos or "").upper()] = what
            return self
        key = what.upper()
        if key not in OPTIONS:
            warnings.warn(f"unknown option {what!r} is ignored", stacklevel=2)
            return self
        if key in NO_EFFECT:
            warnings.warn(f"option {key} has no effect", stacklevel=2)
        for k in levels:
            target = self.parms if k is None else self.at.setdefault(k, {})
            if pos:
                target[key, pos.upper()] = legal(key, value)
            else:
                target[key] = legal(key, value)
                if key == "SMOOTHER_TYPE":  # a new smoother starts with its own solver
                    target.pop("SUB_SOLVE", None)
        return self

    def option(self, key, level: int, pos: str = ""):
        own = self.at.get(level, {})
        for store in (own, self.parms):
            for k in ((key, pos), key):
                if k in store:
                    return store[k]
        return OPTIONS[key][0]

    def _object(self, role, level, pos=""):
        for k in (level, None):
            for s in (pos, ""):
                if (role, k, s) in self.objects:
                    return self.objects[role, k, s]
        return None

    # Hierarchy

    def build(self, a: DataFrame, p: DataFrame | None = None, n_blocks: int | None = None) -> "Preconditioner":
        """``n_blocks`` contiguous blocks where no partition is given: one for each ``BLOCK_ROWS`` rows unless it is set."""
        return self.hierarchy_build(a, p, n_blocks).smoothers_build()

    def hierarchy_build(self, a: DataFrame, p: DataFrame | None = None, n_blocks: int | None = None) -> "Preconditioner":
        a = blas.cut(blas.assemble(a))
        n, nnz = a.agg(F.countDistinct("i"), F.count("*")).first()
        if p is None:
            lo, hi = a.agg(F.min("i"), F.max("i")).first()
            spark = a.sparkSession
            p = blas.cut(blocks((spark, (hi - lo + 1) if n else 1), n_blocks or -(-n // BLOCK_ROWS) or 1, 1 if lo is None else lo))
        self.levels = [Level(a, p, n, nnz, self.parms)]
        if self.kind != "ML":
            return self
        per = self.option("MIN_COARSE_SIZE_PER_PROCESS", 1)
        target = self.option("MIN_COARSE_SIZE", 1)
        count = p.select("blk").distinct().count()
        target = target if target > 0 else (per if per > 0 else 200) * count
        vector, made = None, None
        while len(self.levels) < self.option("MAX_LEVS", 1) and self.levels[-1].n > target:
            k, top = len(self.levels), self.levels[-1]
            agg = self._object("aggregator", k) or made or self._aggregator(k, vector, target)
            if isinstance(agg, Coupled) and self._object("aggregator", k) is None:
                agg = self._aggregator(k, vector, target)
            parms = Parameters({**self.parms, **self.at.get(k, {})})
            tprol = blas.cut(agg.tentative(top.a, top.p, parms))
            size = tprol.select("j").distinct().count()
            if size == 0 or size >= top.n:
                break
            ratio = top.n / size
            if len(self.levels) >= 2 and ratio < self.option("MIN_CR_RATIO", 1) and size > target:
                break
            prol = self._smooth(k, top.a, tprol)
            coarse = blas.cut(self._clean(k, rap(top.a, prol)))
            top.prol, top.restr, top.tprol = prol, blas.transpose(prol), tprol
            place = blas.cut(tprol.join(top.p, "i").groupBy(F.col("j").alias("i2")).agg(F.min("blk").alias("blk")).withColumnRenamed("i2", "i"))
            n = coarse.select("i").distinct().count()
            if (rows := self.option("REMAP_ROWS", k)) > 0:  # fewer blocks where they have become small
                place = blas.cut(blas.merged_blocks(coarse, place, max(1, -(-n // rows))))
            self.levels.append(Level(coarse, place, n, coarse.count(), self.parms, ratio=ratio))
            vector = agg.next_vector()
        return self

    def _aggregator(self, k, vector, target):
        how = self.option("PAR_AGGR_ALG", k)
        if how == "COUPLED":
            return Coupled(vector, max(self.option("AGGR_SIZE", k), 2 ** self.option("PRMC_SWEEPS", k)), target, self.option("PRMC_NEED_SYMMETRIZE", k))
        return Decoupled(how == "SYMDEC")

    def _smooth(self, k, a, tprol):
        if self.option("AGGR_PROL", k) == "UNSMOOTHED" or self.option("PRMC_UNSMOOTHED_HIERARCHY", k):
            return tprol
        chosen = self.option("AGGR_OMEGA_VAL", k) if self.option("AGGR_OMEGA_ALG", k) == "USER_CHOICE" else omega(a).first()[0]
        return blas.cut(smoothed(a, tprol, self.option("AGGR_THRESH", k), self.option("AGGR_FILTER", k) == "FILTER", chosen))

    def _clean(self, k, a):
        return blas.clean_zeros(a) if self.option("AGGR_CLEAN_ZEROS", k) else a

    def set_hierarchy(self, a: DataFrame, p: DataFrame, maps: list[tuple[DataFrame, DataFrame | None]]) -> "Preconditioner":
        """A hierarchy from given prolongators and restrictions (None: the transpose)."""
        a = blas.cut(a)
        self.levels = [Level(a, p, p.count(), a.count(), self.parms)]
        for prol, restr in maps:
            top = self.levels[-1]
            top.prol, top.restr, top.tprol = prol, restr if restr is not None else blas.transpose(prol), prol
            coarse = blas.cut(rap(top.a, prol, top.restr))
            place = blas.cut(prol.join(top.p, "i").groupBy(F.col("j").alias("i2")).agg(F.min("blk").alias("blk")).withColumnRenamed("i2", "i"))
            n = place.count()
            self.levels.append(Level(coarse, place, n, coarse.count(), self.parms, ratio=top.n / max(n, 1)))
        return self

    def hierarchy_rebuild(self, a: DataFrame) -> "Preconditioner":
        """New values on the finest level; the transfer operators stay."""
        self.levels[0].a = blas.cut(blas.assemble(a))
        for top, low in zip(self.levels, self.levels[1:]):
            low.a = blas.cut(rap(top.a, top.prol, top.restr))
        return self

    def hierarchy_update(self, entries: DataFrame) -> "Preconditioner":
        """New values (i, j, v) of some entries of the finest matrix; on every level only what they change is written.

        A coarse matrix changes by R D P, where D is the change above it.  A level is its table and the changes since, which
        are summed when it is read, and written anew after ``FOLD`` of them.
        """
        top = self.levels[0]
        new = entries.groupBy("i", "j").agg(F.max("v").alias("new"))
        change = blas.cut(new.join(top.a, ["i", "j"], "left").select("i", "j", (F.col("new") - F.coalesce("v", F.lit(0.0))).alias("v")).where("v <> 0"))
        for k, lev in enumerate(self.levels):
            base, changes = lev.extra.get("changes", (lev.a, []))
            changes = [*changes, change]
            whole = base
            for c in changes:
                whole = whole.unionByName(c)
            lev.a = blas.assemble(whole)
            if len(changes) >= FOLD:
                lev.a = base = blas.cut(self._clean(k + 1, lev.a))
                changes = []
            lev.extra["changes"] = (base, changes)
            if k + 1 < len(self.levels):
                change = blas.cut(rap(change, lev.prol, lev.restr))
        return self

    def smoothers_build(self) -> "Preconditioner":
        if not self.levels:
            raise RuntimeError("build the hierarchy first")
        last = len(self.levels)
        for k, lev in enumerate(self.levels, 1):
            if k == last and self.kind == "ML":
                lev.pre = lev.post = self._coarse(k, lev)
            else:
                lev.pre = self._smoother(k, "PRE").build(lev.a, lev.p)
                kind = self._smoother_kind(k, "POST")
                same = kind == self._smoother_kind(k, "PRE") and "FBGS" not in kind and self._object("smoother", k, "POST") is None and self._object("solver", k, "POST") is None
                lev.post = lev.pre if same else self._smoother(k, "POST").build(lev.a, lev.p)
        return self

    def _smoother_kind(self, k, pos):
        if self.kind == "ML" or ("SMOOTHER_TYPE" in self.parms or "SMOOTHER_TYPE" in self.at.get(k, {})):
            return self.option("SMOOTHER_TYPE", k, pos)
        return self.kind

    def _smoother(self, k, pos) -> Smoother:
        if (own := self._object("smoother", k, pos)) is not None:
            return copy.copy(own)
        kind = self._smoother_kind(k, pos)
        opt = lambda key: self.option(key, k, pos)
        more = {"fill": opt("SUB_FILLIN"), "tol": opt("SUB_ILUTHRS"), "sweeps": opt("SOLVER_SWEEPS"), "inv_fill": opt("INV_FILLIN"), "inv_tol": opt("INV_THRESH") if opt("INV_THRESH") >= 0 else None, "variant": opt("AINV_ALG"), **self._inner_krylov(k)}
        s = make(kind, pos == "POST", opt("SUB_SOLVE"), overlap=opt("SUB_OVR"), restr=opt("SUB_RESTR"), prol=opt("SUB_PROL"), **more)
        solver = self._object("solver", k, pos)
        if solver is not None:
            s = BlockJacobi(solver)
        return Converged(s, opt("SMOOTHER_STOPTOL"), opt("SMOOTHER_RESIDUAL")) if opt("SMOOTHER_STOP") else s

    def _inner_krylov(self, k) -> dict:
        """Options of a local Krylov solver."""
        names = {"method": "KRM_METHOD", "itmax": "KRM_ITMAX", "eps": "KRM_EPS", "istop": "KRM_ISTOPC", "irst": "KRM_IRST", "sub_solve": "KRM_SUB_SOLVE", "kprec": "KRM_KPREC", "krm_fill": "KRM_FILLIN", "trace": "KRM_ITRACE"}
        return {n: self.option(key, k) for n, key in names.items()}

    def _coarse(self, k, lev) -> Smoother:
        kind = self.option("COARSE_SOLVE", k)
        one = blas.cut(lev.p.select("i", F.lit(0).alias("blk")))
        lev.extra["sweeps"] = 1
        replicated = kind in ("ILU", "ILUT", "MILU") or (self.option("COARSE_MAT", k) == "REPL" and kind not in (*DIRECT, "JACOBI", "L1-JACOBI"))
        if replicated and lev.n > MAX_REPLICATED:
            raise ValueError(f"a coarse matrix of {lev.n} rows is too large to be replicated; use more levels, or COARSE_MAT DIST with BJAC")
        if kind in DIRECT:
            # One dense block, or the same solution from fronts over all blocks.
            return BlockJacobi(Block("LU")).build(lev.a, one) if lev.n <= DENSE else Multifrontal().build(lev.a, lev.p)
        if kind == "KRM" and self.option("KRM_GLOBAL", k):
            s = GlobalKrylov(self.option("KRM_METHOD", k), self.option("KRM_ITMAX", k), self.option("KRM_EPS", k), self.option("KRM_ISTOPC", k), self.option("KRM_IRST", k), self.option("KRM_FILLIN", k))
            return s.build(lev.a, lev.p)
        more = {"fill": self.option("COARSE_FILLIN", k), "tol": self.option("COARSE_ILUTHRS", k), "inv_fill": self.option("COARSE_INVFILL", k), **self._inner_krylov(k)}
        if self.option("COARSE_MAT", k) == "REPL" and kind not in ("JACOBI", "L1-JACOBI"):  # the whole matrix as one block
            lev.extra["sweeps"] = 1
            sub = self.option("COARSE_SUBSOLVE", k) if "BJAC" in kind else kind
            return BlockJacobi(Block(sub, **more)).build(lev.a, one)
        lev.extra["sweeps"] = self.option("COARSE_SWEEPS", k)
        if kind in ("JACOBI", "L1-JACOBI"):
            return Jacobi(kind.startswith("L1")).build(lev.a, lev.p)
        if kind in ("ILU", "ILUT", "MILU"):  # replicated: one block
            lev.extra["sweeps"] = 1
            return BlockJacobi(Block(kind, **more)).build(lev.a, one)
        sub = self.option("COARSE_SUBSOLVE", k) if "BJAC" in kind else kind
        s = BlockJacobi(Block(sub, **more), kind.startswith("L1")).build(lev.a, lev.p)
        return Converged(s, self.option("BJAC_STOPTOL", k), self.option("BJAC_RESCHECK", k)).build(lev.a, lev.p) if self.option("BJAC_STOP", k) else s

    # Application

    def apply(self, x: DataFrame, trans: str = "N") -> DataFrame:
        if not self.levels or self.levels[0].pre is None:
            raise RuntimeError("build the preconditioner first")
        if self.kind != "ML" or len(self.levels) == 1:
            lev = self.levels[0]
            if self.kind == "ML":
                return lev.pre.apply(x, None, lev.extra.get("sweeps", 1), trans)
            n = max(self.option("SMOOTHER_SWEEPS", 1, "PRE"), self.option("SMOOTHER_SWEEPS", 1, "POST"), 1)
            if lev.post is lev.pre:
                return lev.pre.apply(x, None, n, trans)
            y, pair = None, (lev.pre, lev.post) if trans == "N" else (lev.post, lev.pre)
            for _ in range(n):
                y = pair[1].apply(x, pair[0].apply(x, y, 1, trans), 1, trans)
            return y
        y = self._cycle(1, x, trans)
        for _ in range(self.option("OUTER_SWEEPS", 1) - 1):
            r = blas.cut(blas.axpby(1.0, x, -1.0, blas.spmv(self.levels[0].a, y, trans=trans)))
            y = blas.cut(blas.axpby(1.0, y, 1.0, self._cycle(1, r, trans)))
        return y

    def _cycle(self, k: int, x: DataFrame, trans: str) -> DataFrame:
        lev = self.levels[k - 1]
        if k == len(self.levels):
            return lev.pre.apply(x, None, lev.extra.get("sweeps", 1), trans)
        how = self.option("ML_CYCLE", k)
        pre, post = ("PRE", "POST") if trans == "N" else ("POST", "PRE")
        first, second = (lev.pre, lev.post) if trans == "N" else (lev.post, lev.pre)
        n_pre, n_post = self.option("SMOOTHER_SWEEPS", k, pre), self.option("SMOOTHER_SWEEPS", k, post)
        if how == "ADD":
            y = first.apply(x, None, max(n_pre, 1), trans)
            z = self._cycle(k + 1, blas.cut(blas.spmv(lev.restr, x)), trans)
            return blas.cut(blas.axpby(1.0, y, 1.0, blas.spmv(lev.prol, z)))
        y = first.apply(x, None, n_pre, trans) if n_pre else None
        r = x if y is None else blas.axpby(1.0, x, -1.0, blas.spmv(lev.a, y, trans=trans))
        rc = blas.cut(blas.spmv(lev.restr, r))
        if how.startswith("KCYCLE") and k <= len(self.levels) - 2:
            z = self._inner(k + 1, rc, trans, how == "KCYCLESYM")
        else:
            z = self._cycle(k + 1, rc, trans)
            if how == "WCYCLE" and k < len(self.levels) - 1:
                r2 = blas.cut(blas.axpby(1.0, rc, -1.0, blas.spmv(self.levels[k].a, z, trans=trans)))
                z = blas.cut(blas.axpby(1.0, z, 1.0, self._cycle(k + 1, r2, trans)))
        up = blas.spmv(lev.prol, z)
        y = blas.cut(up if y is None else blas.axpby(1.0, y, 1.0, up))
        return second.apply(x, y, n_post, trans) if n_post else y

    def _inner(self, k, w, trans, symmetric):
        """At most two flexible CG or GCR steps; the second only where the first has not reduced to a quarter."""
        a, s = self.levels[k - 1].a, FrameSpace
        d0 = self._cycle(k, w, trans)
        v = blas.cut(blas.spmv(a, d0, trans=trans))
        ww, delta, tau = s.dots((w, w), (d0 if symmetric else v, w), (d0 if symmetric else v, v))
        if tau == 0:
            return d0
        alpha = delta / tau
        w1 = s.lin((1.0, w), (-alpha, v))
        if math.sqrt(max(s.dots((w1, w1))[0], 0.0)) <= 0.25 * math.sqrt(ww):
            return s.lin((alpha, d0))
        d1 = self._cycle(k, w1, trans)
        v1 = blas.cut(blas.spmv(a, d1, trans=trans))
        lead = d1 if symmetric else v1
        t1, t2, t3 = s.dots((lead, v), (lead, v1), (lead, w1))
        t4 = t2 - t1 * t1 / tau
        if t4 == 0:
            return s.lin((alpha, d0))
        return s.lin((alpha - t1 * t3 / (tau * t4), d0), (t3 / t4, d1))

    # Reports

    def operator_complexity(self) -> float:
        return sum(lev.nnz for lev in self.levels) / max(self.levels[0].nnz, 1)

    def average_coarsening(self) -> float:
        r = [lev.ratio for lev in self.levels[1:]]
        return sum(r) / len(r) if r else 0.0

    def n_levels(self) -> int:
        return len(self.levels)

    def n_entries(self) -> int:
        return sum(lev.nnz for lev in self.levels)

    def size_bytes(self) -> int:
        """Bytes of matrices, transfer operators and what the smoothers made."""
        moved = sum(24 * m.count() for lev in self.levels for m in (lev.prol, lev.tprol) if m is not None)
        made = {id(s): s for lev in self.levels for s in (lev.pre, lev.post) if s is not None}
        return 24 * self.n_entries() + moved + sum(s.size_bytes() for s in made.values())

    def smoother(self, level: int = 1) -> Smoother:
        return self.levels[level - 1].pre

    def solver(self, level: int = 1):
        return getattr(self.levels[level - 1].pre, "solver", None)

    def describe(self) -> str:
        lines = [f"Preconditioner {self.kind}, {len(self.levels)} level(s), operator complexity {self.operator_complexity():.3f}, average coarsening {self.average_coarsening():.2f}"]
        for k, lev in enumerate(self.levels, 1):
            lines.append(f"  level {k}: {lev.n} rows, {lev.nnz} entries, {lev.pre.describe() if lev.pre else 'no smoother'}")
        return "\n".join(lines)

    def dump(self) -> DataFrame:
        """All levels as rows (lev, kind, i, j, v): kinds ac, p, r and tprol."""
        out = None
        for k, lev in enumerate(self.levels, 1):
            for kind, m in (("ac", lev.a), ("p", lev.prol), ("r", lev.restr), ("tprol", lev.tprol)):
                if m is not None:
                    one = m.select(F.lit(k).alias("lev"), F.lit(kind).alias("kind"), "i", "j", "v")
                    out = one if out is None else out.unionByName(one)
        return out

    def clone(self) -> "Preconditioner":
        """A copy with options and levels of its own; matrices and factors, which are never changed, are shared."""
        out = copy.copy(self)
        out.parms, out.at, out.objects = Parameters(self.parms), {k: dict(v) for k, v in self.at.items()}, dict(self.objects)
        out.levels = [copy.copy(lev) for lev in self.levels]
        return out

    def free(self) -> None:
        self.levels = []

    smoothers_free = hierarchy_free = free


def solve(a: DataFrame, b: DataFrame, prec: Preconditioner | None = None, method: str = "CG", x0: DataFrame | None = None, eps: float = 1e-6, itmax: int = 500, istop: int = 2, irst: int = 30, trace: int = -1) -> Result:
    """Krylov solution of A x = b with a built preconditioner."""
    norm = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0] if istop == 1 else 1.0
    m = (lambda v: prec.apply(v)) if prec else None
    mt = (lambda v: prec.apply(v, "T")) if prec else None
    product = lambda v: blas.cut(blas.spmv(a, v))
    return krylov(method, product, b, x0, m, FrameSpace, eps, itmax, istop, irst, norm or 1.0, trace, lambda v: blas.cut(blas.spmv(a, v, trans="T")), mt)
