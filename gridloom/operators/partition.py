"""Distribution of the nodes of a matrix by its graph: multilevel partitioning to parts of equal size with a small cut.

Coarsening pairs nodes along heavy edges in a few rounds (ties by a hash of the edge, so that many pairs form in a round);
what stays single is grouped with nodes of the same heaviest neighbour.  The coarsest graph of a part has at most
``COARSEST`` nodes (checked) and is halved in one task, by the order of the second eigenvector of its Laplacian, again and
again.  On the way back nodes move between parts by gain, on levels that have grown ``GROWN`` times and on the finest (on
others only out of parts that are too large); moves of a round go in one direction, so that neighbours do not swap, and only
into parts that have room.  Tables with a row a node are hashed where they are (``vec``); no level of them goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.blas import cut, vec
from gridloom.operators.graph import mutual_round

#: Nodes of a part at which coarsening ends, and the most that one task halves.
COARSE, COARSEST = 2000, 4000
#: Nodes for which all eigenvectors are found.
WHOLE = 300
#: Parts that a part is divided to at once.
STAGE = 64
PAIR_ROUNDS, REFINE_ROUNDS = 3, 4
#: Growth of a level over the last refined one that makes it refined.
GROWN = 2.5


def _weighted(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (i, size) and edges (i, j, w) in both directions, with w = |a_ij| + |a_ji|."""
    off = a.where("i <> j").select("i", "j", F.abs("v").alias("w"))
    edges = off.union(off.select("j", "i", "w")).groupBy("i", "j").agg(F.sum("w").alias("w")).where("w > 0")
    return cut(a.select("i").union(a.select("j")).distinct().withColumn("size", F.lit(1).cast("long"))), cut(edges)


def _clusters(nodes: DataFrame, edges: DataFrame, largest: int) -> DataFrame:
    """Nodes with their cluster c: pairs of nodes, and groups of single ones with a common heaviest neighbour; c is the least member."""
    mark = F.xxhash64(F.least("i", "j"), F.greatest("i", "j")) / F.lit(2.0**63)
    both = edges.select("i", "j", (F.col("w") * (1.0 + mark / 100.0)).alias("v"))
    small = nodes.where(F.col("size") <= largest).select("i")
    both = cut(both.join(vec(small), "i", "left_semi").join(vec(small.select(F.col("i").alias("j"))), "j", "left_semi").select("i", "j", "v"))
    ends = None
    for _ in range(PAIR_ROUNDS):
        new = cut(mutual_round(both))
        one = new.select("i", F.col("i").alias("c")).union(new.select(F.col("j").alias("i"), F.col("i").alias("c")))
        ends = one if ends is None else ends.union(one)
        both = both.join(vec(one), "i", "left_anti").join(vec(one.select(F.col("i").alias("j"))), "j", "left_anti").select("i", "j", "v")
        both = cut(both)
    single = small.join(vec(ends), "i", "left_anti")
    hub = edges.join(vec(single), "i", "left_semi").groupBy("i").agg(F.max_by("j", F.struct("w", "j")).alias("hub"))
    many = hub.groupBy("hub").agg(F.count("*").alias("n"))
    place = hub.join(vec(many), "hub").where("n > 1").select("i", "hub", F.expr("pmod(xxhash64(i), (n + 1) div 2)").alias("b"))
    group = place.groupBy("hub", "b").agg(F.min("i").alias("c"))
    ends = ends.union(place.join(vec(group), ["hub", "b"]).select("i", "c"))
    return cut(nodes.join(vec(ends), "i", "left").select("i", "size", "top", F.coalesce("c", "i").alias("c")))


def _second(lap: np.ndarray) -> np.ndarray:
    """The second eigenvector of a Laplacian; of a large one by inverse iteration of a few vectors."""
    n = len(lap)
    if n <= WHOLE:
        return np.linalg.eigh(lap)[1][:, min(1, n - 1)]
    mean = np.trace(lap) / n or 1.0
    lap = lap + mean / n  # the constant vector becomes one of the last
    inv = np.linalg.inv(lap + 1e-9 * mean * np.eye(n))
    x = np.random.default_rng(7).normal(size=(n, 6))
    for _ in range(20):
        x, _ = np.linalg.qr(inv @ x)
    return x @ np.linalg.eigh(x.T @ lap @ x)[1][:, 0]


def halves(w: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """Part numbers of the nodes of a small dense graph; numbers of one half are below those of the other."""
    out = np.zeros(len(size), np.int32)
    if parts == 1 or len(size) == 0:
        return out
    first = parts // 2
    lap = np.diag(w.sum(1)) - w
    vector = _second(lap)
    order = np.lexsort((np.arange(len(size)), np.round(vector, 9)))
    before = np.cumsum(size[order]) - size[order] / 2
    low = np.zeros(len(size), bool)
    low[order[before <= size.sum() * first / parts]] = True
    for _ in range(4):  # single moves by gain, while the halves keep their sizes
        pull = w @ np.where(low, 1.0, -1.0)
        gain = np.where(low, -pull, pull)
        room = 0.02 * size.sum()
        moved = False
        for k in np.argsort(-gain, kind="stable")[:50]:
            now = np.where(low, 1.0, -1.0)
            g = float(-(w[k] @ now) * now[k])
            after = size[low].sum() + (-size[k] if low[k] else size[k]) - size.sum() * first / parts
            if g > 1e-12 and abs(after) <= room:
                low[k], moved = not low[k], True
        if not moved:
            break
    out[low] = halves(w[np.ix_(low, low)], size[low], first)
    out[~low] = first + halves(w[np.ix_(~low, ~low)], size[~low], parts - first)
    return out


def _split(nodes: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(i, blk, size): each part ``top`` of the nodes is divided to ``parts`` in a task of its own."""
    own = nodes.select("top", "i", F.col("i").alias("j"), F.col("size").cast("double").alias("w"))
    rows = own.union(edges.join(vec(nodes.select("i", "top")), "i").select("top", "i", "j", "w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf.i.to_numpy(), return_inverse=True)
        if len(ids) > COARSEST:
            raise ValueError(f"the graph does not contract below {len(ids)} nodes; at most {COARSEST} are halved in one task")
        to, on = np.searchsorted(ids, pdf.j.to_numpy()), (pdf.i == pdf.j).to_numpy()
        w, size, v = np.zeros((len(ids), len(ids))), np.zeros(len(ids)), pdf.w.to_numpy()
        size[at[on]] = v[on]
        w[at[~on], to[~on]] = v[~on]
        return pd.DataFrame({"i": ids, "blk": (pdf.top.iloc[0] * parts + halves(w, size, parts)).astype("int32"), "size": size.astype("int64")})

    return rows.groupBy("top").applyInPandas(run, "i long, blk int, size long")


def _refine(edges: DataFrame, p: DataFrame, cap: float, rounds: int = REFINE_ROUNDS) -> DataFrame:
    """Moves of the nodes (i, blk, size) by gain; from parts above ``cap`` also at a loss, until they are below it."""
    for k in range(rounds + REFINE_ROUNDS):
        size = p.groupBy("blk").agg(F.sum("size").alias("s"))  # one row a part
        if k >= rounds and (size.agg(F.max("s")).first()[0] or 0) <= cap:
            break
        over, room = size.select("blk", (F.col("s") - cap).alias("over")), size.select(F.col("blk").alias("to"), (cap - F.col("s")).alias("room"))
        ends = edges.join(vec(p.select(F.col("i").alias("j"), F.col("blk").alias("to"))), "j").select("i", "to", "w").repartition("i")
        pull = ends.groupBy("i", "to").agg(F.sum("w").alias("w"))
        all_ = pull.join(vec(p), "i").groupBy("i", "blk", "size").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("blk"), F.col("w"))), F.lit(0.0)).alias("own"), F.max(F.when(F.col("to") != F.col("blk"), F.struct("w", "to"))).alias("best"))
        move = all_.where("best is not null").select("i", "blk", "size", F.col("best.to").alias("to"), (F.col("best.w") - F.col("own")).alias("gain"))
        move = move.where("to > blk" if k % 2 else "to < blk").join(over, "blk").join(room, "to")
        move = move.where("gain > 1e-12 or over > 0")
        out = F.sum("size").over(Window.partitionBy("blk").orderBy(F.desc("gain"), "i"))
        into = F.sum("size").over(Window.partitionBy("to").orderBy(F.desc("gain"), "i"))
        move = move.withColumn("out", out).where("gain > 1e-12 or out <= over + size").withColumn("into", into).where("into <= room").select("i", "to")
        p = cut(p.join(vec(move), "i", "left").select("i", F.coalesce("to", "blk").alias("blk"), "size"))
    return p


def _stages(parts: int) -> list[int]:
    """Factors of ``parts`` of at most ``STAGE``, where there are such."""
    out = []
    while parts > STAGE:
        k = next((k for k in range(STAGE, 1, -1) if parts % k == 0), parts)
        out.append(k)
        parts //= k
    return [*out, parts] if parts > 1 or not out else out


def graph_partition(a: DataFrame, parts: int, tolerance: float = 0.05) -> DataFrame:
    """(i, blk) with ``parts`` parts of at most (1 + ``tolerance``) times the mean size and few, light edges between them.

    More than ``STAGE`` parts are made in stages: each part is divided again, all of them in the same jobs and each coarsest
    graph in a task of its own.  Parts are numbered by repeated halving: for a power of two the leading bits of a number
    name the halves.
    """
    nodes, edges = _weighted(a)
    total = nodes.count()
    if not total:
        return nodes.select("i", F.lit(0).alias("blk"))
    p, made, stages = nodes.select("i", F.lit(0).alias("blk")), 1, _stages(parts)
    for k, more in enumerate(stages, 1):
        if made > 1:  # edges inside the parts so far
            ends = edges.join(vec(p.withColumnRenamed("blk", "bi")), "i").join(vec(p.select(F.col("i").alias("j"), F.col("blk").alias("bj"))), "j")
            edges = cut(ends.where("bi = bj").select("i", "j", "w"))
        made *= more
        cap = (1 + 0.8 * tolerance * k / len(stages)) * total / made
        p = _divided(cut(nodes.join(vec(p.withColumnRenamed("blk", "top")), "i").select("i", "size", "top")), edges, more, made, total, cap).select("i", "blk")
    return p


def _divided(nodes: DataFrame, edges: DataFrame, more: int, made: int, total: int, cap: float) -> DataFrame:
    """(i, blk, size): every part ``top`` of the nodes (i, size, top), which no edge leaves, divided to ``more``; ``made`` in all."""

    def counts(nodes):
        return nodes.groupBy("top").count().agg(F.sum("count"), F.max("count")).first()

    levels, (n, most) = [], counts(nodes)
    largest = max(1, total // (6 * made))
    while most > max(COARSE, 8 * more):
        map_ = _clusters(nodes, edges, largest)
        up = cut(map_.groupBy(F.col("c").alias("i")).agg(F.sum("size").alias("size"), F.min("top").alias("top")))
        ci, cj = map_.select("i", "c"), map_.select(F.col("i").alias("j"), F.col("c").alias("cj"))
        between = cut(edges.join(vec(ci), "i").join(vec(cj), "j").where("c <> cj").groupBy("c", "cj").agg(F.sum("w").alias("w")).toDF("i", "j", "w"))
        less, most = counts(up)
        if less > 0.95 * n:
            break
        levels.append((n, edges, map_))
        nodes, edges, n = up, between, less
    p = _refine(edges, cut(_split(nodes, edges, more)), cap, REFINE_ROUNDS if levels else 0)
    for k, (more_nodes, edges, map_) in enumerate(reversed(levels), 1):
        p = map_.select("i", "c", "size").join(vec(p.select(F.col("i").alias("c"), "blk")), "c").select("i", "blk", "size")
        whole = more_nodes >= GROWN * n or k == len(levels)
        p, n = _refine(edges, cut(p), cap, REFINE_ROUNDS if whole else 0), more_nodes if whole else n
    return p


def cut_weight(a: DataFrame, p: DataFrame) -> DataFrame:
    """One row: weight of the edges between parts and of all edges (each edge once), nodes, parts, and the largest part."""
    _, edges = _weighted(a)
    e = edges.where("i < j").join(vec(p.select("i", F.col("blk").alias("bi"))), "i").join(vec(p.select(F.col("i").alias("j"), F.col("blk").alias("bj"))), "j")
    w = e.agg(F.coalesce(F.sum(F.when(F.col("bi") != F.col("bj"), F.col("w"))), F.lit(0.0)).alias("cut"), F.sum("w").alias("all"))
    s = p.groupBy("blk").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), F.count("*").alias("parts"), F.max("n").alias("largest"))
    return w.crossJoin(s)  # one row each
