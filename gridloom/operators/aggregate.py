"""Coarsening: decoupled strength-based aggregation, coupled matching, user-supplied maps; prolongators."""

from __future__ import annotations

import itertools
import math
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blas import block_of, cut, diag, given_diag, reciprocal, spgemm, spmv, symmetrize, transpose, vec
from gridloom.operators.graph import FOLD, edge_weights, matching, omega, smoother_matrix
from gridloom.scratch import cut_by

UNSET = -1
#: Entries of a block that one task aggregates.
MAX_BLOCK = 400_000


def soc_block(i, j, v, theta: float, kind: str = "SOC1", order: str = "NATURAL", turn: dict[int, int] | None = None) -> dict[int, int]:
    """Aggregates of one block in three phases; the value is the number of the aggregate, missing nodes are excluded.
    ``turn`` may give the order in which nodes are looked at.

    Roots are nodes whose strong neighbourhood is untouched; then nodes join their strongest aggregated neighbour as
    of the end of the first phase; then leftovers gather what is still free around them.
    """
    nodes = sorted({*i})
    known = set(nodes)
    d = {a: 0.0 for a in nodes}
    rows: dict[int, list[tuple[int, float]]] = {a: [] for a in nodes}
    for a, b, x in sorted(zip(i, j, v)):
        if a == b:
            d[a] += x
        if b in known:
            rows[a].append((b, x))
    second = kind == "SOC2"

    def coupling(a, b, x):
        s = math.sqrt(abs(d[a] * d[b]))
        return (abs(x) / s if s else 0.0) if second else abs(x)

    def is_strong(a, b, x):
        s = math.sqrt(abs(d[a] * d[b]))
        return (s > 0 and abs(x) / s >= theta) if second else abs(x) > theta * s

    near = {a: [(b, coupling(a, b, x)) for b, x in r if is_strong(a, b, x)] for a, r in rows.items()}
    todo = sorted(nodes, key=lambda a: (-len(rows[a]), a)) if order == "DEGREE" else nodes
    todo = todo if turn is None else sorted(nodes, key=lambda a: (turn[a], a))
    agg = dict.fromkeys(nodes, UNSET)
    count, excluded = 0, set()
    for a in todo:
        if agg[a] != UNSET or a in excluded:
            continue
        if second and all(b == a for b, _ in rows[a]):
            excluded.add(a)
            continue
        if all(agg[b] == UNSET and b not in excluded for b, _ in near[a]):
            for b, _ in near[a]:
                agg[b] = count
            agg[a] = count
            count += 1
    first = dict(agg)
    single = {a for a in nodes if len(rows[a]) <= 1}
    for a in todo:
        if agg[a] == UNSET and a not in excluded and (second or a not in single):
            best, at = 0.0, None
            for b, c in near[a]:
                if first[b] != UNSET and c > best:
                    best, at = c, b
            if at is not None:
                agg[a] = first[at]
    for a in todo:
        if agg[a] == UNSET and a not in excluded and (second or a not in single):
            free = [b for b, _ in (rows[a] if second else near[a]) if agg[b] == UNSET and b not in excluded]
            for b in free:
                agg[b] = count
            agg[a] = count
            count += 1
    return {a: k for a, k in agg.items() if k != UNSET}


def soc_aggregates(a: DataFrame, p: DataFrame, theta: float = 0.01, kind: str = "SOC1", order: str = "NATURAL") -> DataFrame:
    """(i, agg) by blocks without communication; aggregates are numbered by (block, local number) from 1.

    A block of more than ``MAX_BLOCK`` entries is too large for a task: then all are aggregated in rounds, with the same result.
    """
    local = _inside(a, p)
    if (local.groupBy("blk").count().agg(F.max("count")).first()[0] or 0) > MAX_BLOCK:
        return _in_rounds(local, theta, kind, order, True, None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = soc_block(pdf.i.tolist(), pdf.j.tolist(), pdf.v.tolist(), theta, kind, order)
        return pd.DataFrame({"blk": np.int32(pdf.blk.iloc[0]), "i": list(m), "k": list(m.values())}, columns=["blk", "i", "k"]).astype({"blk": "int32", "i": "int64", "k": "int64"})

    m = cut(local.select("blk", "i", "j", "v").groupBy("blk").applyInPandas(run, "blk int, i long, k long"))
    return number_blocks(m)


def _inside(a: DataFrame, p: DataFrame) -> DataFrame:
    """Entries inside the blocks with the diagonals of both ends, (blk, i, j, v, di, dj), in buckets of their rows: they move once."""
    d = cut(p.select("i", "blk").join(given_diag(a).withColumnRenamed("v", "d"), "i", "left").select("i", "blk", F.coalesce("d", F.lit(0.0)).alias("d")))
    by_column = a.join(vec(d.select(F.col("i").alias("j"), F.col("blk").alias("bj"), F.col("d").alias("dj"))), "j")
    both = by_column.join(vec(d.select("i", "blk", F.col("d").alias("di"))), "i").where("blk = bj")
    return cut_by(both.select("blk", "i", "j", "v", "di", "dj"), "i", dealt=True)


def number_blocks(m: DataFrame) -> DataFrame:
    """Global numbers from local ones: prefix sums of the blocks' counts (one row for each block)."""
    from pyspark.sql import Window

    n = m.groupBy("blk").agg((F.max("k") + 1).alias("n"))
    base = n.select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("base"))
    return m.join(base, "blk").select("i", (F.col("k") + F.col("base") + 1).alias("agg"))


#: A multiplier that spreads node numbers over 32 bits.
SPREAD = 1540483477


def hashed(i):
    """Priorities that look random and are the same on every machine: SQL of a node number ``i``."""
    h = f"({i} % 4294967296 * {SPREAD} % 4294967296)"
    return f"(({h} ^ shiftright({h}, 15)) * {SPREAD} % 4294967296)"


def first_set(near: DataFrame, turn: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """(i): the nodes that taking nodes in turn picks, where a pick needs all its ``near`` (i, j) untouched and touches them.

    In rounds, without pairs of nodes: every j learns the first open node that wants it, every node whether it is the
    first for all it wants.  A round picks the first open node at least; with random turns there are O(log n) rounds.
    ``turn`` is (i, turn), with different turns.  Also the number of rounds.
    """
    live, out = cut(near.join(turn, "i").select("i", "j", "turn")), None
    for done in itertools.count():
        if not live.limit(1).count():
            return (turn.select("i").limit(0) if out is None else out), done
        if done == max_rounds:
            raise RuntimeError(f"first_set: nodes are undecided after {max_rounds} rounds")
        least = live.groupBy("j").agg(F.min("turn").alias("least"))
        seen = live.join(least, "j").groupBy("i").agg(F.max(F.col("turn") > F.col("least")).alias("later"))
        new = cut(seen.where("not later").select("i"))
        out = new if out is None else out.union(new)
        if done % FOLD == FOLD - 1:
            out = cut(out)
        touched = live.join(new, "i", "left_semi").select("j").distinct()
        gone = live.join(touched, "j", "left_semi").select("i").distinct()
        live = cut(live.join(gone, "i", "left_anti"))
    raise AssertionError


def soc_rounds(a: DataFrame, p: DataFrame, theta: float = 0.01, kind: str = "SOC1", order: str = "HASHED", number: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(i, agg): the aggregates of ``soc_block`` by joins, without a task for a block.

    Roots come in rounds (``first_set``); the others join their strongest neighbour of the first phase (the least of equal
    ones); what is left opens aggregates in turn, again in rounds.  ``order`` is NATURAL, DEGREE or HASHED, the one with few
    rounds.  Aggregates are numbered by (block, turn) as in ``soc_aggregates``, or named by their first node.
    """
    return _in_rounds(_inside(a, p), theta, kind, order, number, max_rounds)


def _in_rounds(local: DataFrame, theta: float, kind: str, order: str, number: bool, max_rounds: int | None) -> DataFrame:
    """``soc_rounds`` of the entries (blk, i, j, v, di, dj) inside the blocks, which stay in buckets of their rows."""
    from pyspark.sql import Window

    second = kind == "SOC2"
    info = local.groupBy("blk", "i").agg(F.count("*").alias("deg"), F.max(F.col("i") != F.col("j")).alias("linked"))
    key = {"NATURAL": [F.col("i")], "DEGREE": [F.desc("deg"), F.col("i")], "HASHED": [F.expr(hashed("i")), F.col("i")]}[order]
    if number or order == "DEGREE":
        turn = F.row_number().over(Window.partitionBy("blk").orderBy(*key)).cast("long")
    else:
        turn = F.expr(f"{hashed('i')} * 2147483648 + i % 2147483648") if order == "HASHED" else F.col("i")
    info = cut(info.withColumn("turn", turn))
    scale = F.sqrt(F.abs(F.col("di") * F.col("dj")))
    coupling = F.when(scale > 0, F.abs("v") / scale).otherwise(0.0) if second else F.abs("v")
    is_strong = (scale > 0) & (F.abs("v") / scale >= theta) if second else F.abs("v") > scale * theta
    ends = local.where("i <> j").select("i", "j", coupling.alias("c"), is_strong.alias("strong"))
    strong = cut(ends.where("strong").select("i", "j", "c"))
    able = info.where("linked") if second else info
    # Turns of different blocks may be equal: blocks do not meet.
    near = strong.select("i", "j").union(able.select("i", F.col("i").alias("j")))
    roots, _ = first_set(near, able.select("i", "turn"), max_rounds)
    roots = cut(roots.join(info.select("i", "blk", "turn"), "i"))
    first = cut(near.join(roots.select("i"), "i", "left_semi").select(F.col("j").alias("i"), F.col("i").alias("root")).distinct())
    open_ = able if second else info.where("deg > 1")
    free = open_.select("i").join(first, "i", "left_anti")
    wanted = strong.where("c > 0").join(free, "i", "left_semi").join(first.select(F.col("i").alias("j"), "root"), "j")
    joined = cut(wanted.groupBy("i").agg(F.max_by("root", F.struct("c", -F.col("j"))).alias("root")))
    rest = cut(info.select("i", "turn", "deg", "linked", "blk").join(first.select("i").union(joined.select("i")), "i", "left_anti").where("linked" if second else "true"))
    takes = (ends if second else strong).select("i", "j")
    takes = takes.join(rest.select("i"), "i", "left_semi").join(rest.select(F.col("i").alias("j")), "j", "left_semi")
    opener = rest if second else rest.where("deg > 1")
    takes = cut(takes.join(opener.select("i"), "i", "left_semi"))
    opened = cut(_openers(takes, opener.select("i", "turn"), max_rounds).join(info.select("i", "blk", "turn"), "i"))
    taken = takes.join(opened.select("i", "turn"), "i").join(opened.select(F.col("i").alias("j")), "j", "left_anti").groupBy("j").agg(F.min_by("i", "turn").alias("root")).select(F.col("j").alias("i"), "root")
    agg = first.select("i", "root").unionByName(joined).unionByName(opened.select("i", F.col("i").alias("root"))).unionByName(taken)
    if not number:
        return agg.select("i", F.col("root").alias("agg"))
    heads = roots.withColumn("late", F.lit(0)).unionByName(opened.withColumn("late", F.lit(1)))
    k = (F.row_number().over(Window.partitionBy("blk").orderBy("late", "turn")) - 1).cast("long")
    heads = heads.select("blk", F.col("i").alias("root"), k.alias("k"))
    return number_blocks(cut(agg.join(heads, "root").select("blk", "i", "k")))


def _openers(takes: DataFrame, turn: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(i): nodes that open an aggregate when they come in turn, unless an earlier one that opens takes them (i takes j)."""
    live, open_, out = cut(takes.join(turn, "i").select("i", "j", "turn")), cut(turn), None
    for done in itertools.count():
        if not open_.limit(1).count():
            return turn.select("i").limit(0) if out is None else out
        if done == max_rounds:
            raise RuntimeError(f"soc_rounds: nodes are undecided after {max_rounds} rounds")
        earlier = live.groupBy(F.col("j").alias("i")).agg(F.min("turn").alias("least"))
        new = cut(open_.join(earlier, "i", "left").where("least is null or least > turn").select("i"))
        out = new if out is None else out.union(new)
        if done % FOLD == FOLD - 1:
            out = cut(out)
        gone = new.union(live.join(new, "i", "left_semi").select("j")).distinct()
        open_ = cut(open_.join(gone, "i", "left_anti"))
        live = cut(live.join(gone, "i", "left_anti").join(gone.select(F.col("i").alias("j")), "j", "left_anti"))
    raise AssertionError


def soc_roots(a: DataFrame, p: DataFrame, theta: float = 0.01, max_rounds: int | None = None) -> DataFrame:
    """Phase-one roots in natural order, in rounds: the same as the sequential rule, without a task for each block.

    A chain in natural order settles one root a round; ``soc_rounds`` has an order with few rounds.
    """
    near = _inside(a, p).where(F.abs("v") > F.sqrt(F.abs(F.col("di") * F.col("dj"))) * theta).select("i", "j")
    nodes = a.select("i").where("i is not null").distinct()
    near = near.union(nodes.select("i", F.col("i").alias("j"))).distinct()
    return first_set(near, nodes.select("i", F.col("i").alias("turn")), max_rounds)[0]


def tentative(agg: DataFrame) -> DataFrame:
    """P(i, agg) = 1."""
    return agg.select("i", F.col("agg").alias("j"), F.lit(1.0).alias("v"))


def smoothed(a: DataFrame, pt: DataFrame, theta: float = 0.0, use_filter: bool = False, w: float | None = None) -> DataFrame:
    """(I - w D^-1 A_F) P with w of the unfiltered matrix unless it is given."""
    w = omega(a).first()[0] if w is None else w
    return (_filter_smoothed(a, pt, theta, w) if use_filter else spgemm(smoother_matrix(a, w), pt)).where("v <> 0")


def _filter_smoothed(a: DataFrame, pt: DataFrame, theta: float, w: float) -> DataFrame:
    """(I - w D^-1 A_F) P, where entries meet the rows of P by their columns and move once, to their own rows.

    A row of the result is P_i (1 - w r f) - w r (strong entries times their rows of P), with f the filtered diagonal and
    r its reciprocal.
    """
    from pyspark.sql import Window

    d = cut(given_diag(a))
    bare = cut(pt.select("i").distinct().join(d, "i", "left_anti"))
    if bare.limit(1).count():  # rows without a diagonal get a zero
        a = a.select("i", "j", "v").unionByName(bare.join(a, "i", "left_semi").select("i", F.col("i").alias("j"), F.lit(0.0).alias("v")))
    first = F.row_number().over(Window.partitionBy("i").orderBy("j")) == 1  # an entry counts once for the diagonal
    p = pt.select(F.col("i").alias("j"), F.col("j").alias("c"), F.col("v").alias("pv"), first.alias("first"))
    ends = cut(p.join(d.select(F.col("i").alias("j"), F.col("v").alias("dj")), "j", "full"))
    e = a.where("i is not null").join(vec(ends), "j", "left").join(vec(d.select("i", F.col("v").alias("di"))), "i", "left")
    scale = F.sqrt(F.abs(F.coalesce("di", F.lit(0.0)) * F.coalesce("dj", F.lit(0.0))))
    on, weak, once = F.col("i") == F.col("j"), F.abs("v") < scale * theta, F.coalesce("first", F.lit(True))
    zero = F.lit(0.0)
    sums = e.groupBy("i", "c").agg(
        F.coalesce(F.max(F.when(on, F.col("pv"))), zero).alias("own"),
        F.coalesce(F.sum(F.when(~on & ~weak, F.col("v") * F.col("pv"))), zero).alias("s"),
        F.coalesce(F.sum(F.when(once & on, F.col("v")).when(once & weak, -F.col("v"))), zero).alias("f"),
    )
    f = F.sum("f").over(Window.partitionBy("i"))
    out = sums.select("i", "c", "own", "s", f.alias("f")).where("c is not null")
    return out.select("i", F.col("c").alias("j"), (F.col("own") * (1.0 - w * reciprocal(F.col("f")) * F.col("f")) - w * reciprocal(F.col("f")) * F.col("s")).alias("v"))


def rap(a: DataFrame, p: DataFrame, r: DataFrame | None = None) -> DataFrame:
    """R A P; R is the transpose of P unless it is given.  A P is summed where its rows are, and stays there for R."""
    right = p.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    ap = a.withColumnRenamed("j", "k").join(right, "k").select("i", F.col("c").alias("j"), (F.col("v") * F.col("w")).alias("v")).repartition("i")
    return spgemm(transpose(p) if r is None else r, ap.groupBy("i", "j").agg(F.sum("v").alias("v")))


def matching_prolongator(nodes: DataFrame, pairs: DataFrame, w: DataFrame) -> DataFrame:
    """Pairs get w over the norm of the pair, single nodes the sign of w; nodes with w near zero are dropped.

    Columns are numbered by the smaller node of each pair.
    """
    ends = pairs.select(F.col("i").alias("own"), F.col("i").alias("i")).union(pairs.select(F.col("i").alias("own"), F.col("j").alias("i")))
    all_ = nodes.select("i").distinct().join(ends, "i", "left").withColumn("own", F.coalesce("own", "i")).join(w.select("i", F.col("v").alias("w")), "i").where("abs(w) > 1e-15")
    norm = all_.groupBy("own").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return all_.join(norm, "own").select("i", F.col("own").alias("j"), (F.col("w") / F.col("norm")).alias("v"))


class Aggregator(ABC):
    """Makes a tentative prolongator from a matrix; users may supply their own."""

    @abstractmethod
    def tentative(self, a: DataFrame, p: DataFrame, parms) -> DataFrame: ...

    def next_vector(self) -> DataFrame | None:
        return None


class Decoupled(Aggregator):
    def __init__(self, symmetric: bool = False):
        self.symmetric = symmetric

    def tentative(self, a, p, parms):
        m = symmetrize(block_of(a, p).where("bi = bj").select("i", "j", "v")) if self.symmetric else a
        how = soc_rounds if parms.aggr_ord == "HASHED" else soc_aggregates
        return tentative(how(m, p, parms.aggr_thresh, parms.aggr_type, parms.aggr_ord))


class Coupled(Aggregator):
    """ceil(log2 AGGR_SIZE) sweeps of pairwise matching; stops early at the target size."""

    def __init__(self, w: DataFrame | None = None, size: int = 2, target: int = 0, symmetrize_first: bool = False):
        self.w, self.size, self.target, self.symmetric = w, size, target, symmetrize_first

    def tentative(self, a, p, parms):
        cur, prod = a, None
        w = self.w or diag(a).select("i", F.lit(1.0).alias("v"))
        for _ in range(max(1, math.ceil(math.log2(max(self.size, 2))))):
            m = symmetrize(cur) if self.symmetric else cur
            # Weights that differ by rounding only are ties, so the same pairs come out on any partitioning.
            weights = edge_weights(m, w).withColumn("v", F.round("v", 10))
            pt = cut(matching_prolongator(diag(cur), matching(weights), w))
            prod = pt if prod is None else cut(spgemm(prod, pt))
            w = cut(spmv(pt, w, trans="T"))
            cur = cut(rap(cur, pt))
            if self.target and cur.select("i").distinct().count() <= self.target:
                break
        self._next = w
        return prod

    def next_vector(self):
        return self._next


class UserMaps(Aggregator):
    """Given prolongators, one for each level."""

    def __init__(self, maps: list[DataFrame]):
        self.maps, self.at = maps, 0

    def tentative(self, a, p, parms):
        self.at += 1
        return self.maps[self.at - 1]
