"""Linear algebra operators against dense numpy and sequential rules."""

import math


import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregate, blas, graph, local
from gridloom.operators.krylov import METHODS, NumpySpace, krylov
from gridloom.operators.local import Block
from gridloom.operators.smooth import BlockJacobi, Converged, Jacobi, Schwarz, Smoother, make
from gridloom.plans.preconditioner import NO_EFFECT, OPTIONS, Preconditioner, solve
from gridloom.sources import files, generators


def mat(spark, m, start=1):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a) + start, int(b) + start, float(m[a, b])) for a, b in zip(i, j)], "i long, j long, v double")


def vec(spark, x, start=1):
    return spark.createDataFrame([(k + start, float(v)) for k, v in enumerate(x)], "i long, v double")


def dense(df, n, m=None, start=1):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[r.i - start, r.j - start] += r.v
    return out


def column(df, n, start=1):
    out = np.zeros(n)
    for r in df.collect():
        out[r.i - start] += r.v
    return out


def grid(spark, n=6, kind="const", count=3):
    a, b = generators.poisson(spark, 2, n, kind)
    a, b = blas.cut(a), blas.cut(b)
    return a, b, generators.blocks((spark, n * n), count), dense(a, n * n), column(b, n * n)


def rand(n, seed=0, density=0.4):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < density)
    return m + np.eye(n) * 5


def test_products_and_norms(spark):
    m, k = rand(7, 1), rand(7, 2)
    x, y = np.arange(7.0), np.linspace(-1, 1, 7)
    a, b, xs, ys = mat(spark, m), mat(spark, k), vec(spark, x), vec(spark, y)
    assert np.allclose(column(blas.spmv(a, xs, 2.0, ys, -3.0), 7), 2 * m @ x - 3 * y)
    assert np.allclose(column(blas.spmv(a, xs, trans="T"), 7), m.T @ x)
    assert np.allclose(dense(blas.spgemm(a, b), 7), m @ k)
    assert blas.dot(xs, ys) == pytest.approx(x @ y) and blas.nrm2(ys) == pytest.approx(np.linalg.norm(y)) and blas.amax(ys) == 1
    assert blas.frobenius(a) == pytest.approx(np.linalg.norm(m))
    z = m.astype(complex) * (1 + 2j)
    ca = a.withColumn("v", F.struct(F.col("v").alias("re"), (F.col("v") * 2).alias("im")))
    cx = xs.withColumn("v", F.struct(F.col("v").alias("re"), F.lit(1.0).alias("im")))
    for trans, op in (("N", z), ("T", z.T), ("C", z.conj().T)):
        got = {r.i: complex(r.v.re, r.v.im) for r in blas.complex_spmv(ca, cx, trans).collect()}
        assert np.allclose([got[i + 1] for i in range(7)], op @ (x + 1j))
    assert blas.complex_dot(cx, cx) == pytest.approx(np.vdot(x + 1j, x + 1j))


def test_edge_matrices(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert blas.spmv(empty, vec(spark, [1.0])).count() == 0 and blas.dot(vec(spark, []), vec(spark, [])) == 0
    one = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 1, 0.0)], "i long, j long, v double")
    assert {(r.i, r.j): r.v for r in blas.clean_zeros(blas.assemble(one)).collect()} == {(1, 1): 5.0}
    assert {r.i: r.v for r in blas.inv_diag(one).collect()} == {1: 0.2, 2: 1.0}


def test_strength_filter_omega(spark):
    m = rand(9, 3)
    a = mat(spark, m)
    d = np.sqrt(np.abs(np.outer(m.diagonal(), m.diagonal())))
    want = np.where(np.abs(m) > 0.2 * d, m, 0)
    assert np.allclose(dense(graph.strong1(a, 0.2), 9), want)
    off = ~np.eye(9, dtype=bool)
    weak = off & (np.abs(m) < 0.2 * d)
    f = np.where(weak, 0, m)
    f[np.arange(9), np.arange(9)] -= np.where(weak, m, 0).sum(1)
    assert np.allclose(dense(graph.filtered(a, 0.2), 9), f)
    w = 4 / (3 * np.max(np.abs(np.abs(m).sum(1) / m.diagonal())))
    assert graph.omega(a).first()[0] == pytest.approx(w)
    assert np.allclose(dense(graph.smoother_matrix(a, w), 9), np.eye(9) - w * m / m.diagonal()[:, None])
    tie = spark.createDataFrame([(1, 1, 4.0), (2, 2, 4.0), (1, 2, 1.0), (2, 1, 1.0)], "i long, j long, v double")
    assert graph.strong1(tie, 0.25).where("i <> j").count() == 0 and graph.mu(tie, 0.25).where("strong and i <> j").count() == 2


def test_matching_is_valid_and_maximal(spark):
    a, _, _, m, _ = grid(spark, 6)
    w = graph.edge_weights(a)
    pairs = [(r.i, r.j) for r in graph.matching(w).collect()]
    used = [k for p in pairs for k in p]
    assert len(used) == len(set(used)) and all(m[i - 1, j - 1] for i, j in pairs)
    free = set(range(1, 37)) - set(used)
    assert not any(m[i - 1, j - 1] for i in free for j in free if i != j)
    s = graph.matching_statistics(a, graph.matching(w)).first()
    assert (s.nodes, s.pairs, s.unmatched) == (36, len(pairs), len(free))


def test_rounds_go_on_to_the_end_or_fail(spark):
    def path(n):
        return [(k, k + 1) for k in range(1, n)]

    w = spark.createDataFrame([(i, j, 1.0) for i, j in path(12)], "i long, j long, v double")
    assert sorted((r.i, r.j) for r in graph.matching(w).collect()) == [(k, k + 1) for k in range(1, 12, 2)]
    n = 310
    a = spark.createDataFrame([(k, k, 2.0) for k in range(1, n + 1)] + [(i, j, -1.0) for p, q in path(n) for i, j in ((p, q), (q, p))], "i long, j long, v double")
    p = spark.createDataFrame([(k, 1) for k in range(1, n + 1)], "i long, blk int")
    assert sorted(r.i for r in aggregate.soc_roots(a, p).collect()) == list(range(1, n + 1, 3))
    for run in (lambda: graph.matching(w, max_rounds=2), lambda: aggregate.soc_roots(a, p, max_rounds=2)):
        with pytest.raises(RuntimeError, match="after 2 rounds"):
            run()


def test_aggregation_rules(spark):
    lone = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (2, 3, -0.9), (3, 2, -0.9)], "i long, j long, v double")
    p = generators.blocks((spark, 3), 1)
    assert {r.i for r in aggregate.soc_aggregates(lone, p).collect()} == {1, 2, 3}
    assert {r.i for r in aggregate.soc_aggregates(lone, p, kind="SOC2").collect()} == {2, 3}
    a, _, part, m, _ = grid(spark, 8)
    for kind in ("SOC1", "SOC2"):
        for order in ("NATURAL", "DEGREE"):
            got = [(r.i, r.agg) for r in aggregate.soc_aggregates(a, part, 0.01, kind, order).collect()]
            assert sorted(i for i, _ in got) == list(range(1, 65))
            assert sorted({k for _, k in got}) == list(range(1, len({k for _, k in got}) + 1))
    blk = {r.i: r.blk for r in part.collect()}
    agg = {r.i: r.agg for r in aggregate.soc_aggregates(a, part).collect()}
    assert all(blk[i] == blk[j] for i in agg for j in agg if agg[i] == agg[j])
    # Roots by rounds equal the roots of the sequential rule.
    near = {i: {j for j in range(64) if abs(m[i, j]) > 0.01 * math.sqrt(m[i, i] * m[j, j]) and blk[j + 1] == blk[i + 1]} for i in range(64)}
    taken, roots = set(), set()
    for i in range(64):
        if not (near[i] & taken):
            roots.add(i + 1)
            taken |= near[i] | {i}
    assert {r.i for r in aggregate.soc_roots(a, part).collect()} == roots


def test_transfer_and_coupled_hierarchy(spark):
    a, _, part, m, _ = grid(spark, 6)
    pt = blas.cut(aggregate.tentative(aggregate.soc_aggregates(a, part)))
    nc = pt.agg(F.max("j")).first()[0]
    t = dense(pt, 36, nc)
    w = graph.omega(a).first()[0]
    s = (np.eye(36) - w * m / m.diagonal()[:, None]) @ t
    p = blas.cut(aggregate.smoothed(a, pt))
    assert np.allclose(dense(p, 36, nc), s) and np.allclose(dense(aggregate.rap(a, p), nc), s.T @ m @ s)
    c = aggregate.Coupled(size=4)
    q = c.tentative(a, part, None)
    assert q.groupBy("i").count().where("count > 1").count() == 0 and q.select("j").distinct().count() <= 18
    assert np.allclose(column(blas.spmv(q, c.next_vector()), 36), 1)


@pytest.mark.parametrize("kind", ["LU", "ILU", "MILU", "ILUT", "INVK", "INVT", "AINV", "GS", "BGS", "JACOBI", "L1-JACOBI", "DIAG", "KRM"])
def test_local_solvers(kind):
    n = 12
    m = np.diag(np.full(n, 4.0)) - np.diag(np.ones(n - 1), 1) - 0.5 * np.diag(np.ones(n - 1), -1)
    i, j = np.nonzero(m)
    b = Block(kind, fill=n, sweeps=60, inv_fill=n, tol=0.0)
    f = b.factor(n, i.tolist(), j.tolist(), m[i, j].tolist())
    x = np.arange(1.0, n + 1)
    y = b.solve(f, x)
    want = x / 4 if kind == "DIAG" else np.linalg.solve(m, x)
    assert np.allclose(y, want, atol=1e-4 if kind == "KRM" else 1e-8)
    if kind in ("LU", "ILU", "MILU", "ILUT", "INVK", "INVT", "AINV"):
        assert np.allclose(b.solve(f, x, trans="T"), np.linalg.solve(m.T, x))


def test_incomplete_factors_and_updates():
    rng = np.random.default_rng(1)
    m = np.where(rng.random((10, 10)) < 0.3, rng.random((10, 10)), 0) + np.eye(10) * 6
    i, j = np.nonzero(m)
    low, piv, up = local.ilu(local.rows_of(10, i, j, m[i, j]), 0)
    lo = np.eye(10) + sum((np.eye(10)[:, [r]] @ np.eye(10)[[c]] * v for r, row in enumerate(low) for c, v in row.items()), np.zeros((10, 10)))
    hi = np.diag(1 / piv) + sum((np.eye(10)[:, [r]] @ np.eye(10)[[c]] * v for r, row in enumerate(up) for c, v in row.items()), np.zeros((10, 10)))
    assert np.allclose((lo @ hi)[m != 0], m[m != 0])  # exact on the pattern
    low, piv, up = local.ilu(local.rows_of(10, i, j, m[i, j]), 0, modified=True)
    assert np.allclose(local.lu_apply(local.factored(low, piv, up), m.sum(1)), 1)  # row sums are kept
    d = np.diag(np.arange(1.0, 6.0))
    f = local.ainv(local.rows_of(5, range(5), range(5), d.diagonal()), 0.0)
    assert np.allclose(local.inverse_apply(local.diagonal_update(f, np.ones(5)), np.ones(5)), 1 / (np.arange(1.0, 6.0) + 1))


def test_smoothers_against_dense(spark):
    a, b, part, m, x = grid(spark, 6, "box")
    blk = np.array([r.blk for r in part.orderBy("i").collect()])
    same = blk[:, None] == blk[None, :]
    d = m.diagonal()
    y = x / d
    y = y + (x - m @ y) / d
    assert np.allclose(column(Jacobi().build(a, part).apply(b, sweeps=2), 36), y)
    inside, off = np.where(same, m, 0), np.where(same, 0, m)
    y = np.linalg.solve(inside, x)
    y = np.linalg.solve(inside, x - off @ y)
    assert np.allclose(column(BlockJacobi(Block("LU")).build(a, part).apply(b, sweeps=2), 36), y)
    s = np.abs(off).sum(1)
    y = np.linalg.solve(inside + np.diag(s), x)
    y = np.linalg.solve(inside + np.diag(s), x - (off - np.diag(s)) @ y)
    assert np.allclose(column(BlockJacobi(Block("LU"), l1=True).build(a, part).apply(b, sweeps=2), 36), y)
    y = np.linalg.solve(np.tril(inside), x)
    y = np.linalg.solve(np.tril(inside), x - off @ y - np.triu(inside, 1) @ y)
    assert np.allclose(column(make("GS").build(a, part).apply(b, sweeps=2), 36), y)
    one = generators.blocks((spark, 36), 1)
    assert not np.allclose(column(make("GS").build(a, one).apply(b, sweeps=2), 36), y)
    assert np.allclose(column(Jacobi().build(a, one).apply(b), 36), x / d)


def test_schwarz_against_dense(spark):
    a, b, part, m, x = grid(spark, 6)
    blk = np.array([r.blk for r in part.orderBy("i").collect()])
    out = {k: np.zeros(36) for k in ("SUM", "AVG", "NONE")}
    n = np.zeros(36)
    for k in set(blk.tolist()):
        own = np.flatnonzero(blk == k)
        more = np.flatnonzero((m[own] != 0).any(0))
        z = np.linalg.solve(m[np.ix_(more, more)], x[more])
        out["SUM"][more] += z
        n[more] += 1
        out["NONE"][own] = z[np.searchsorted(more, own)]
    out["AVG"] = out["SUM"] / n
    for prol, want in out.items():
        assert np.allclose(column(Schwarz(Block("LU"), 1, "HALO", prol).build(a, part).apply(b), 36), want)


@pytest.mark.parametrize("method", METHODS)
def test_krylov_methods(method):
    rng = np.random.default_rng(3)
    m = np.diag(np.arange(2.0, 32.0)) + 0.3 * (k := rng.normal(size=(30, 30))) @ k.T / 30
    x = rng.normal(size=30)
    for istop in (1, 2, 3):
        got = krylov(method, lambda v: m @ v, m @ x, prec=lambda v: v / m.diagonal(), space=NumpySpace, eps=1e-10, itmax=200, istop=istop, a_norm=np.abs(m).sum(1).max(), a_t=lambda v: m.T @ v)
        assert got.converged and np.allclose(got.x, x, atol=1e-6), (method, istop)


def test_multigrid_solve_beats_plain(spark):
    a, b, part, m, x = grid(spark, 12, count=2)
    want = np.linalg.solve(m, x)
    pre = Preconditioner("ML").set("MIN_COARSE_SIZE", 20).build(a, part)
    got = solve(a, b, pre, "CG", eps=1e-6, itmax=30)
    plain = krylov("CG", lambda v: m @ v, x, space=NumpySpace, eps=1e-6)
    assert got.converged and got.iterations < plain.iterations and np.allclose(column(got.x, 144), want, rtol=1e-3, atol=1e-5)
    assert pre.n_levels() >= 2 and pre.operator_complexity() > 1 and pre.average_coarsening() > 1.5
    assert "level 2" in pre.describe() and {r.kind for r in pre.dump().select("kind").distinct().collect()} == {"ac", "p", "r", "tprol"}
    u, w = vec(spark, np.sin(np.arange(144))), vec(spark, np.cos(np.arange(144)))
    assert blas.dot(pre.apply(u), w) == pytest.approx(blas.dot(u, pre.apply(w)), rel=1e-8)  # forward then backward sweeps
    pre.hierarchy_rebuild(blas.scale(a, 2.0)).smoothers_build()
    assert blas.dot(pre.apply(b), b) > 0


def test_cycles_reduce_the_residual(spark):
    a, b, part, m, x = grid(spark, 8, count=1)
    for cycle in ("VCYCLE", "WCYCLE", "KCYCLE", "KCYCLESYM"):
        pre = Preconditioner("ML").set("ML_CYCLE", cycle).set("SMOOTHER_TYPE", "L1-JACOBI").set("MIN_COARSE_SIZE", 4).build(a, part)
        y = column(pre.apply(b), 64)
        assert np.linalg.norm(x - m @ y) < 0.8 * np.linalg.norm(x), cycle
    two = Preconditioner("ML").set("OUTER_SWEEPS", 2).set("SMOOTHER_TYPE", "JACOBI").set("MIN_COARSE_SIZE", 20).build(a, part)
    one = Preconditioner("ML").set("SMOOTHER_TYPE", "JACOBI").set("MIN_COARSE_SIZE", 20).build(a, part)
    y1 = column(one.apply(b), 64)
    assert np.allclose(column(two.apply(b), 64), y1 + column(one.apply(vec(spark, x - m @ y1)), 64))


def test_options_and_plug_ins(spark):
    a, b, part, m, x = grid(spark, 4, count=2)
    with pytest.warns(UserWarning):
        assert Preconditioner().set("AGGR_THRESH", 7.0).option("AGGR_THRESH", 1) == 0.01
    with pytest.warns(UserWarning, match="unknown option"):
        pre = Preconditioner().set("no such key", 1)
    for key in NO_EFFECT:
        with pytest.warns(UserWarning, match="no effect"):
            Preconditioner().set(key, OPTIONS[key][0])
    pre = pre.set("SMOOTHER_SWEEPS", 3, ilev=2, pos="PRE").set("aggr_prol", "unsmoothed")
    assert (pre.option("SMOOTHER_SWEEPS", 2, "PRE"), pre.option("SMOOTHER_SWEEPS", 2, "POST"), pre.option("AGGR_PROL", 1)) == (3, 1, "UNSMOOTHED")
    with pytest.raises(ValueError):
        Preconditioner("nothing")
    with pytest.raises(RuntimeError):
        Preconditioner("JACOBI").apply(b)

    class Third(Smoother):
        def apply(self, x, y=None, sweeps=1, trans="N"):
            return blas.scale(x, 1 / 3)

    assert np.allclose(column(Preconditioner("JACOBI").set(Third()).build(a, part).apply(b), 16), x / 3)
    for kind in ("NONE", "DIAG", "L1-JACOBI", "GS", "BWGS", "FBGS", "BJAC", "L1-BJAC", "AS"):
        assert Preconditioner(kind).build(a, part).apply(b).count() > 0
    for coarse in ("BJAC", "GS", "ILU", "KRM", "JACOBI", "UMF"):
        pre = Preconditioner("ML").set("COARSE_SOLVE", coarse).set("KRM_GLOBAL", coarse == "KRM").set("MIN_COARSE_SIZE", 6).build(a, part)
        assert pre.apply(b).count() == 16
    for alg in ("SYMDEC", "COUPLED"):
        assert Preconditioner("ML").set("PAR_AGGR_ALG", alg).set("MIN_COARSE_SIZE", 6).build(a, part).n_levels() >= 2
    s = Converged(Jacobi(), 1e-1).build(a, part)
    s.apply(b, sweeps=50)
    assert s.trace[-1][1] <= 1e-1 and len(s.trace) < 50
    assert len(OPTIONS) > 60


def test_files(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 4\n1 1 2.0\n2 2 3.0\n3 1 -1.5\n3 3 1.0\n")
    assert sorted(map(tuple, files.read_matrix(spark, str(tmp_path / "m.mtx")).collect())) == [(1, 1, 2.0), (1, 3, -1.5), (2, 2, 3.0), (3, 1, -1.5), (3, 3, 1.0)]
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix array real general\n% c\n3 1\n1.5\n-2e0\n3\n")
    assert sorted(map(tuple, files.read_array(spark, str(tmp_path / "b.mtx")).collect())) == [(1, 1.5), (2, -2.0), (3, 3.0)]
    assert files.read_array(spark, "NONE") is None
    hb = [f"{'title':<72}{'key':<8}", f"{4:14d}{1:14d}{1:14d}{1:14d}{1:14d}", f"{'RUA':<14}{2:14d}{2:14d}{3:14d}{0:14d}", f"{'(4I4)':<16}{'(4I4)':<16}{'(3E12.4)':<20}{'(3E12.4)':<20}", f"{'F':<14}{1:14d}{0:14d}", f"{1:4d}{3:4d}{4:4d}", f"{1:4d}{2:4d}{2:4d}", f"{4.0:12.4E}{1.0:12.4E}{5.0:12.4E}", f"{1.0:12.4E}{2.0:12.4E}"]
    (tmp_path / "h.rua").write_text("\n".join(hb) + "\n")
    got = files.read_harwell_boeing(spark, str(tmp_path / "h.rua"))
    assert sorted(map(tuple, got["matrix"].collect())) == [(1, 1, 4.0), (2, 1, 1.0), (2, 2, 5.0)]
    assert [r.v for r in got["rhs"].orderBy("i").collect()] == [1.0, 2.0] and got["guess"] is None
    assert files.read_parameters("%skip\nCG ! method\n 1.d-6 !eps\nT\n") == ["CG", "1.d-6", "T"] and files.parameter("1.d-6", float) == 1e-6 and files.parameter("T", bool)
    a = files.read_matrix(spark, str(tmp_path / "m.mtx"))
    files.write_matrix_market(a, str(tmp_path / "out"), 3, 3)
    assert sorted(map(tuple, files.read_matrix(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, a.collect()))
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 2.0 0.0\n2 1 1.0 -3.0\n")
    assert sorted((r.i, r.j, r.v.re, r.v.im) for r in files.read_matrix(spark, str(tmp_path / "c.mtx")).collect()) == [(1, 1, 2.0, 0.0), (1, 2, 1.0, 3.0), (2, 1, 1.0, -3.0)]
    assert spark.read.text(str(tmp_path / "out/1-entries")).count() == 5
    x = generators.constant_vector(spark, 3, 1.0)
    files.write_solution(x, blas.residual(a, x, x), x, str(tmp_path / "sol"))
    assert spark.read.csv(str(tmp_path / "sol"), header=True).count() == 3


def test_manufactured_solution_of_a_generated_problem(spark):
    """With zero right-hand side terms and g = 1 at x = 0 and 1, solving A u = rhs keeps u between 0 and 1."""
    for dim, n in ((2, 10), (3, 4)):
        for kind in ("const", "exp"):
            a, b = generators.poisson(spark, dim, n, kind)
            u = np.linalg.solve(dense(a, n**dim), column(b, n**dim))
            assert u.min() > 0 and u.max() < 1 + 1e-9


def test_stream_of_values_rebuilds(spark, tmp_path):
    from gridloom.streaming.updates import rebuild_on

    a, b, part, m, x = grid(spark, 4, count=1)
    pre = Preconditioner("ML").set("MIN_COARSE_SIZE", 6).build(a, part)
    src = tmp_path / "updates"
    spark.createDataFrame([(1, 1, 99.0)], "i long, j long, v double").write.parquet(str(src))
    stream = spark.readStream.schema("i long, j long, v double").parquet(str(src))
    w = rebuild_on(stream, pre).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert pre.levels[0].a.where("i = 1 and j = 1").first().v == 99.0


def test_user_hierarchy(spark):
    a, b, part, m, x = grid(spark, 4, count=1)
    pt = aggregate.tentative(part.select("i", F.expr("i div 4 + 1").alias("agg")))
    t = dense(pt, 16, 5)
    pre = Preconditioner("ML").set_hierarchy(a, part, [(pt, None)])
    assert np.allclose(dense(pre.levels[1].a, 5), t.T @ m @ t)
    own = Preconditioner("ML").set(aggregate.UserMaps([pt])).set("AGGR_PROL", "UNSMOOTHED").set("MAX_LEVS", 2).set("MIN_COARSE_SIZE", 2).build(a, part)
    assert np.allclose(dense(own.levels[1].a, 5), t.T @ m @ t)


def test_transposed_sweeps_are_the_transposes(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9, 9)) * (rng.random((9, 9)) < 0.5) + 8 * np.eye(9)
    i, j = np.nonzero(m)
    for kind in ("FWGS", "BWGS"):
        for sweeps in (1, 3):
            s = Block(kind, sweeps=sweeps)
            f = s.factor(9, i.tolist(), j.tolist(), m[i, j].tolist())
            one = np.stack([s.solve(f, e) for e in np.eye(9)], axis=1)
            two = np.stack([s.solve(f, e, None, "T") for e in np.eye(9)], axis=1)
            assert np.allclose(one.T, two)
    a, b, part, m, x = grid(spark, 5, count=2)
    pre = Preconditioner("ML").set("MIN_COARSE_SIZE", 6).build(a, part)
    got = solve(a, b, pre, "BICG", eps=1e-8, itmax=40)
    assert got.converged and np.allclose(m @ column(got.x, 25), x, atol=1e-5)


def test_inner_krylov_options_and_replicated_coarse_matrix(spark):
    a, b, part, m, x = grid(spark, 4, count=2)
    loose = Preconditioner("ML").set("COARSE_SOLVE", "KRM").set("KRM_ITMAX", 1).set("KRM_METHOD", "CG").set("KRM_KPREC", "NONE").set("MIN_COARSE_SIZE", 6).build(a, part)
    tight = Preconditioner("ML").set("COARSE_SOLVE", "KRM").set("KRM_EPS", 1e-12).set("KRM_SUB_SOLVE", "ILUT").set("COARSE_MAT", "REPL").set("MIN_COARSE_SIZE", 6).build(a, part)
    exact = Preconditioner("ML").set("MIN_COARSE_SIZE", 6).build(a, part)
    y, z, w = (column(p.apply(b), 16) for p in (loose, tight, exact))
    assert np.allclose(z, w, atol=1e-8) and not np.allclose(y, w, atol=1e-8)
    twin = exact.clone().set("OUTER_SWEEPS", 3)
    assert exact.option("OUTER_SWEEPS", 1) == 1 and not np.allclose(column(twin.apply(b), 16), w)


def test_large_coarse_matrices_are_solved_over_all_blocks(spark, monkeypatch):
    from gridloom.plans import preconditioner

    a, b, part, m, x = grid(spark, 5, count=2)
    want = column(Preconditioner("ML").set("MIN_COARSE_SIZE", 6).build(a, part).apply(b), 25)
    monkeypatch.setattr(preconditioner, "DENSE", 3)
    got = column(Preconditioner("ML").set("MIN_COARSE_SIZE", 6).build(a, part).apply(b), 25)
    assert np.allclose(got, want, atol=1e-7)


def test_gather_scatter_and_empty_matrices(spark):
    from gridloom.operators import aggregate

    x = spark.createDataFrame([(1, 2.0), (4, -1.0)], "i long, v double")
    assert blas.gather(x).tolist() == [2.0, 0.0, 0.0, -1.0] and blas.replicate(x).value.tolist() == [2.0, 0.0, 0.0, -1.0]
    p = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "i long, blk int")
    assert sorted(map(tuple, blas.scatter(spark, [1.0, 2.0, 3.0, 4.0], p).collect())) == [(1, 1.0, 1), (2, 2.0, 0), (3, 3.0, 1), (4, 4.0, 0)]
    none = spark.createDataFrame([], "i long, j long, v double")
    assert aggregate.soc_roots(none, p).count() == 0


# Triangles by levels, direct solution, partitions, aggregation in rounds, complex systems


@pytest.mark.parametrize("seed", range(3))
def test_triangles_by_levels(seed):
    from gridloom.operators.csr import Csr, Triangle

    rng = np.random.default_rng(seed)
    n = 40
    m = np.where(rng.random((n, n)) < 0.1, rng.normal(size=(n, n)), 0)
    i, j = np.nonzero(m)
    c, x, d = Csr(n, np.tile(i, 2), np.tile(j, 2), np.tile(m[i, j] / 2, 2)), rng.normal(size=n), rng.random(n) + 1
    assert np.allclose(c.times(x), m @ x) and np.allclose(c.times(x, "T"), m.T @ x) and np.allclose(c.diagonal(), m.diagonal())
    for part, t in ((c.lower(), np.tril(m, -1)), (c.upper(), np.triu(m, 1))):
        tri = Triangle(part)
        assert np.allclose(tri.solve(x), np.linalg.solve(t + np.eye(n), x))
        assert np.allclose(tri.solve(x, d), np.linalg.solve(t + np.diag(1 / d), x))
        assert np.allclose(tri.transposed().solve(x), np.linalg.solve(t.T + np.eye(n), x))
    assert [sorted(r.items()) for r in c.rows()] == [[(k, v) for k, v in enumerate(row) if v] for row in m.tolist()]
    empty = Csr(0, [], [], [])
    assert len(Triangle(empty).levels) == 0 and len(empty.times(np.zeros(0))) == 0


def test_sweeps_of_a_large_block_take_no_python_step_an_entry():
    import time

    side = 300
    i = np.arange(side * side)
    e = [(i, i, np.full(len(i), 4.0))]
    for k, ok in ((1, i % side < side - 1), (side, i < side * (side - 1))):
        e += [(i[ok], i[ok] + k, np.full(ok.sum(), -1.0)), (i[ok] + k, i[ok], np.full(ok.sum(), -1.0))]
    b = Block("GS")
    f = b.factor(side * side, *(np.concatenate(x) for x in zip(*e)))
    began = time.time()
    b.solve(f, np.ones(side * side), np.ones(side * side))
    assert time.time() - began < 1


@pytest.mark.parametrize("variant", ["LLK", "STAB-LLK", "SYM-LLK"])
def test_biconjugation_visits_what_meets(variant):
    rng = np.random.default_rng(4)
    m = np.where(rng.random((20, 20)) < 0.15, rng.random((20, 20)), 0)
    m = m + m.T + np.eye(20) * 8 if variant != "LLK" else m + np.eye(20) * 8
    i, j = np.nonzero(m)
    b = Block("AINV", variant=variant)
    assert np.allclose(b.solve(b.factor(20, i, j, m[i, j]), np.arange(20.0)), np.linalg.solve(m, np.arange(20.0)))
    few = Block("AINV", variant=variant, inv_fill=1).factor(20, i, j, m[i, j])
    below = [sum(m[r, c] != 0 for c in range(r)) for r in range(20)]
    assert all(len(row) <= below[r] + 2 for r, row in enumerate(few[0].rows()))


def test_inverse_thresholds_and_fill_act():
    rng = np.random.default_rng(5)
    m = np.where(rng.random((30, 30)) < 0.2, rng.random((30, 30)), 0) + np.eye(30) * 6
    i, j = np.nonzero(m)
    sizes = [len(Block("INVT", fill=30, tol=1e-9, **more).factor(30, i, j, m[i, j])[0].val) for more in ({}, {"inv_tol": 1e-2}, {"inv_fill": 1}, {"inv_tol": 1e-1})]
    assert sizes[0] > sizes[1] > sizes[3] and sizes[0] > sizes[2]


def test_approximate_inverses_are_applied_by_products(spark):
    a, b, part, m, x = grid(spark, 6, "box")
    for kind in ("INVK", "INVT", "AINV"):
        s = BlockJacobi(Block(kind)).build(a, part)
        plan = s.factors.sparkSession._jvm.PythonSQLUtils.explainString(blas.spmv(s.inverse[0], blas.spmv(s.inverse[1], blas.spmv(s.inverse[2], b)))._jdf.queryExecution(), "simple")
        assert "Python" not in plan and "InPandas" not in plan
        got, back = column(s.apply(b), 36), column(s.apply(b, trans="T"), 36)
        dump = {k: dense(s.dump()["factors"].where(F.col("kind") == k), 36) for k in "zdw"}
        inverse = dump["z"] @ dump["d"] @ dump["w"]
        assert np.allclose(got, inverse @ x) and np.allclose(back, inverse.T @ x)


def test_direct_solver_equals_dense(spark):
    from gridloom.operators.direct import Multifrontal

    a, b, part, m, x = grid(spark, 9, "box")
    s = Multifrontal(leaf=8).build(a)
    assert s.depth == 4 and s.size_bytes() > 0
    assert np.allclose(column(s.apply(b), 81), np.linalg.solve(m, x)) and np.allclose(column(s.apply(b, trans="T"), 81), np.linalg.solve(m.T, x))
    # Two components, a node that nothing touches, an empty row, node numbers with gaps.
    two = np.zeros((14, 14))
    two[:6, :6], two[6:12, 6:12] = rand(6, 3), rand(6, 4)
    two[12, 12] = 2.0
    e = mat(spark, two).withColumn("i", F.col("i") * 10).withColumn("j", F.col("j") * 10)
    e = e.union(spark.createDataFrame([(140, 140, 0.0)], "i long, j long, v double"))
    rhs = np.arange(1.0, 15)
    got = {r.i: r.v for r in Multifrontal(leaf=3).build(blas.cut(e)).apply(vec(spark, rhs).withColumn("i", F.col("i") * 10)).collect()}
    two[13, 13] = 1.0  # an empty row stands for itself
    assert np.allclose([got[10 * (k + 1)] for k in range(14)], np.linalg.solve(two, rhs))


def test_fronts_above_the_limit_are_an_error(spark, monkeypatch):
    import pandas as pd

    from gridloom.operators import direct

    monkeypatch.setattr(direct, "MAX_FRONT", 2)
    own = pd.DataFrame({"node": [1] * 3, "i": [1, 2, 3], "j": [None] * 3, "v": [0.0] * 3})
    with pytest.raises(ValueError, match="front of 3"):
        direct.eliminated(own, pd.DataFrame({"node": [], "bnd": [], "s": []}))


def test_graph_partition(spark, monkeypatch):
    from gridloom.operators import partition

    a, _, _, _, _ = grid(spark, 16)
    got = partition.cut_weight(a, partition.graph_partition(a, 4)).first()
    rows = partition.cut_weight(a, generators.blocks((spark, 256), 4)).first()
    assert (got.nodes, got.parts) == (256, 4) and got.largest <= 1.05 * 64 and got.cut <= 1.15 * rows.cut
    monkeypatch.setattr(partition, "COARSE", 40)  # several levels
    got = partition.cut_weight(a, partition.graph_partition(a, 4)).first()
    assert got.largest <= 1.05 * 64 and got.cut <= 1.3 * rows.cut
    star = spark.createDataFrame([(1, k, 1.0) for k in range(2, 200)] + [(k, k, 1.0) for k in range(1, 200)] + [(500, 500, 1.0)], "i long, j long, v double")
    sizes = [r["count"] for r in partition.graph_partition(star, 4).groupBy("blk").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 1.05 * 50 + 1
    assert partition.graph_partition(star.limit(0), 4).count() == 0


@pytest.mark.parametrize("kind", ["SOC1", "SOC2"])
@pytest.mark.parametrize("order", ["HASHED", "NATURAL", "DEGREE"])
def test_aggregates_in_rounds_equal_the_sequential_rule(spark, kind, order):
    rng = np.random.default_rng(7)
    n = 60
    m = np.where(rng.random((n, n)) < 0.06, -rng.random((n, n)), 0)
    m = m + m.T + np.eye(n) * 1.5
    m[5, :] = m[:, 5] = 0
    m[5, 5] = 1.0
    a = blas.cut(mat(spark, m))
    p = spark.range(1, n + 1).select(F.col("id").alias("i"), (F.col("id") % 3).cast("int").alias("blk"))
    turns = {r.i: r.t for r in spark.range(1, n + 1).select(F.col("id").alias("i"), F.expr(aggregate.hashed("id")).alias("t")).collect()}
    got = {r.i: r.agg for r in aggregate.soc_rounds(a, p, 0.05, kind, order).collect()}
    want, base = {}, 0
    for blk in range(3):
        ids = [k for k in range(1, n + 1) if k % 3 == blk]
        e = [(i, j, m[i - 1, j - 1]) for i in ids for j in ids if m[i - 1, j - 1]]
        one = aggregate.soc_block(*zip(*e), 0.05, kind, order if order != "HASHED" else "NATURAL", turns if order == "HASHED" else None)
        want |= {i: base + k + 1 for i, k in one.items()}
        base += max(one.values()) + 1
    assert got == want


def test_a_long_path_is_aggregated_in_few_rounds(spark):
    n = 1000
    a = blas.cut(spark.createDataFrame([(k, k, 2.0) for k in range(n)] + [(i, j, -1.0) for k in range(n - 1) for i, j in ((k, k + 1), (k + 1, k))], "i long, j long, v double"))
    p = spark.range(n).select(F.col("id").alias("i"), F.lit(0).alias("blk"))
    got = aggregate.soc_rounds(a, p, 0.01, number=False, max_rounds=20)
    assert got.count() == n and 250 <= got.select("agg").distinct().count() <= 500


def test_blocks_are_merged_where_they_become_small(spark):
    a, b, _, m, x = grid(spark, 16)
    merged = Preconditioner("ML").set("MIN_COARSE_SIZE", 80).set("SMOOTHER_TYPE", "L1-JACOBI").set("REMAP_ROWS", 8)
    merged.build(a, generators.blocks((spark, 256), 64))
    blocks = [lev.p.select("blk").distinct().count() for lev in merged.levels]
    assert blocks[0] == 64 and blocks[-1] <= 16
    got = solve(a, b, merged, "CG", eps=1e-4, itmax=30)
    assert got.converged and np.allclose(column(got.x, 256), np.linalg.solve(m, x), atol=1e-2)
    alone = spark.createDataFrame([(k, k, 1.0) for k in range(8)], "i long, j long, v double")
    assert blas.merged_blocks(alone, spark.range(8).select(F.col("id").alias("i"), F.col("id").cast("int").alias("blk")), 3).select("blk").distinct().count() == 2


def test_complex_systems(spark):
    from gridloom.operators import complexes

    rng = np.random.default_rng(2)
    n = 12
    m = rand(n, 6, 0.3) + 1j * rand(n, 7, 0.3)
    i, j = np.nonzero(m)
    a = spark.createDataFrame([(int(p), int(q), (float(m[p, q].real), float(m[p, q].imag))) for p, q in zip(i, j)], "i long, j long, v struct<re:double,im:double>")
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    b = spark.createDataFrame([(k, (float(v.real), float(v.imag))) for k, v in enumerate(m @ x)], "i long, v struct<re:double,im:double>")
    p = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("blk"))
    got = complexes.solve_complex(a, b, Preconditioner("BJAC"), p, "BICGSTAB", eps=1e-10, itmax=60)
    assert got.converged and np.allclose([complex(r.v.re, r.v.im) for r in got.x.orderBy("i").collect()], x, atol=1e-7)
    h = complexes.hermitian(a)
    want = m.conj().T @ (m @ x)
    assert np.allclose([complex(r.v.re, r.v.im) for r in blas.complex_spmv(h, b).orderBy("i").collect()], want)


def test_partitions_of_numbers_from_zero_cover_all_nodes(spark):
    a = spark.createDataFrame([(k, k, 2.0) for k in range(9)], "i long, j long, v double")
    pre = Preconditioner("BJAC").build(a, n_blocks=3)
    assert sorted(r.i for r in pre.levels[0].p.collect()) == list(range(9)) and pre.size_bytes() > 24 * 9


def test_replicated_coarse_matrices_have_a_limit(spark, monkeypatch):
    from gridloom.plans import preconditioner

    a, b, part, m, x = grid(spark, 5, count=2)
    monkeypatch.setattr(preconditioner, "MAX_REPLICATED", 3)
    with pytest.raises(ValueError, match="too large to be replicated"):
        Preconditioner("ML").set("MIN_COARSE_SIZE", 6).set("COARSE_SOLVE", "ILU").build(a, part)


#: Norms of the published right-hand side and solution (2-norm; largest value).
GOLDEN_RHS, GOLDEN_X = 45068.0961497, (31.9096588607, 0.973136546)


def test_published_problem_of_4096_unknowns(spark):
    """The 64 x 64 problem with g = exp(-y^2) at x = 0 and 1 at x = 1: norms of its published solution."""
    from gridloom.operators.csr import Csr

    side, h = 64, 1 / 66
    a, _ = generators.poisson(spark, 2, side, a="1D", b=("0D", "0D"), c="0D")
    e = a.toPandas()
    m = Csr(side * side, e.i - 1, e.j - 1, e.v)
    b = np.zeros((side, side))
    b[0] += np.exp(-((np.arange(side) * h) ** 2))
    b[-1] += 1.0
    b[0, 0] += 1.0  # the corners lie on x = 0 too
    b[0, -1] += np.exp(-1.0)
    got = krylov("CG", m.times, b.ravel() / h**2, space=NumpySpace, eps=1e-10, itmax=1000)
    assert got.converged and m.val.max() == pytest.approx(4 * 66**2)
    assert np.linalg.norm(b / h**2) == pytest.approx(GOLDEN_RHS, rel=1e-6)
    assert np.linalg.norm(got.x) == pytest.approx(GOLDEN_X[0], rel=1e-5) and np.abs(got.x).max() == pytest.approx(GOLDEN_X[1], rel=1e-5)


def test_layout_of_the_sample_programs(spark):
    from gridloom.plans import runs

    smoother = ["FBGS", "2", "0", "HALO", "NONE", "ILU", "3", "LLK", "1", "0", "1.d-3"]
    text = "\n".join(["% a run", "CSR", "0003", "CONST ! coefficients", "CG", "2", "00080", "1", "30", "1.d-7", "a name of mine", "ML", *smoother, "NONE", *smoother[1:], "WCYCLE", "1", "-3", "4", "SMOOTHED", "DEC", "SOC1", "8", "DEGREE", "-1.5", "FILTER", "-0.01d0", "2", "0.05 0.025", "BJAC", "ILU", "DIST", "0", "1.d-4", "3", "F", "1"])
    general, pre = runs.read_layout(text)
    assert (general["idim"], general["name"], general["rest"]) == ("0003", "a name of mine", ["F", "1"])
    want = {"ML_CYCLE": "WCYCLE", "MAX_LEVS": 20, "MIN_COARSE_SIZE_PER_PROCESS": 4, "AGGR_ORD": "DEGREE", "MIN_CR_RATIO": 1.5, "AGGR_FILTER": "FILTER", "SMOOTHER_SWEEPS": 2, "SUB_FILLIN": 1, "SUB_ILUTHRS": 1e-3, "COARSE_SWEEPS": 3}
    assert {k: pre.option(k, 3) for k in want} == want and [pre.option("AGGR_THRESH", k) for k in (1, 2, 3)] == [0.05, 0.025, 0.01]
    two = text.replace("\nNONE\n2\n0", "\nJACOBI\n4\n0")
    assert runs.read_layout(two)[1].option("SMOOTHER_SWEEPS", 1, "POST") == 4 and runs.read_layout(two)[1].option("SMOOTHER_SWEEPS", 1, "PRE") == 2
    with pytest.raises(ValueError, match="values"):
        runs.read_layout("CSR\n")
    got = runs.run_layout(spark, text.replace("\nML\n", "\nL1-JACOBI\n"), blocks=2)
    assert got.converged and got.residual_2 < 1e-5


def test_updates_write_what_changes(spark):
    a, b, part, m, x = grid(spark, 8, count=2)
    make = lambda: Preconditioner("ML").set("MIN_COARSE_SIZE", 6).hierarchy_build(a, part)
    some, whole = make(), make()
    new = m.copy()
    for step in range(3):
        new[step, step], new[step + 8, step] = 9000.0 + step, -7.0
        e = spark.createDataFrame([(step + 1, step + 1, 9000.0 + step), (step + 9, step + 1, -7.0)], "i long, j long, v double")
        some.hierarchy_update(e)
    whole.hierarchy_rebuild(mat(spark, new))
    for one, other in zip(some.levels, whole.levels):
        assert np.allclose(dense(one.a, 64), dense(other.a, 64))
    written = [c.count() for c in some.levels[0].extra["changes"][1]]
    assert written == [2, 2, 2] and all(c.count() <= 60 for c in some.levels[1].extra["changes"][1])


def test_complex_harwell_boeing_files(spark, tmp_path, monkeypatch):
    lines = [f"{'a complex matrix':72}key", f"{5:14}{1:14}{1:14}{2:14}{1:14}", f"{'CHA':14}{2:14}{2:14}{3:14}{0:14}", f"{'(3I4)':16}{'(3I4)':16}{'(4F8.2)':20}{'(4F8.2)':20}", f"{'F':14}{1:14}{0:14}"]
    lines += [f"{1:4}{3:4}{4:4}", f"{1:4}{2:4}{2:4}", f"{2:8.2f}{0:8.2f}{1:8.2f}{0.5:8.2f}", f"{3:8.2f}{0:8.2f}", f"{1:8.2f}{-1:8.2f}{0:8.2f}{2:8.2f}"]
    path = tmp_path / "c.hb"
    path.write_text("\n".join(lines) + "\n")
    got = files.read_harwell_boeing(spark, str(path))
    assert {(r.i, r.j): complex(r.v.re, r.v.im) for r in got["matrix"].collect()} == {(1, 1): 2, (2, 1): 1 + 0.5j, (1, 2): 1 - 0.5j, (2, 2): 3}
    assert [complex(r.v.re, r.v.im) for r in got["rhs"].orderBy("i").collect()] == [1 - 1j, 2j] and got["guess"] is None
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        files.read_harwell_boeing(spark, str(path))


def test_traces_keep_every_step(caplog):
    import logging

    m = rand(8, 3)
    with caplog.at_level(logging.INFO):
        got = krylov("BICGSTAB", lambda v: m @ v, np.ones(8), space=NumpySpace, eps=1e-10, itmax=60, trace=2)
    assert [k for k, _ in got.history] == list(range(got.iterations + 1)) and got.history[-1][1] == got.error <= 1e-10
    assert len([r for r in caplog.records if "iteration" in r.message]) == got.iterations // 2 + 1


def test_many_parts_are_made_in_stages(spark, monkeypatch):
    from gridloom.operators import partition

    monkeypatch.setattr(partition, "COARSE", 16)
    monkeypatch.setattr(partition, "COARSEST", 60)
    monkeypatch.setattr(partition, "STAGE", 4, raising=False)
    a = generators.poisson(spark, 2, 16)[0]  # the coarsest graph of 16 parts at once has up to 128 nodes
    got = partition.cut_weight(a, partition.graph_partition(a, 16, 0.25)).first()
    assert got.nodes == 256 and got.parts == 16 and got.largest <= 1.25 * 16 + 2


def test_parts_that_fit_a_task_are_divided_without_coarsening(spark, monkeypatch):
    from gridloom.operators import partition

    clusters, tops = partition._clusters, []

    def counted(nodes, edges, largest):
        tops.append(nodes.select("top").distinct().count())
        return clusters(nodes, edges, largest)

    monkeypatch.setattr(partition, "COARSE", 60)
    monkeypatch.setattr(partition, "STAGE", 8)
    monkeypatch.setattr(partition, "_clusters", counted)
    a = generators.poisson(spark, 2, 20)[0]
    got = partition.cut_weight(a, partition.graph_partition(a, 16, 0.25)).first()
    assert got.nodes == 400 and got.parts == 16 and got.largest <= 1.25 * 25 + 2
    assert tops and set(tops) == {1}  # the eight parts of the first stage have 50 nodes each


def test_second_eigenvector_of_a_large_graph(monkeypatch):
    from gridloom.operators import partition

    n, w = 150, np.zeros((150, 150))
    for k in range(n):
        for m in (k + 1, k + 5):
            if m < n and not (m == k + 1 and m % 5 == 0):
                w[k, m] = w[m, k] = 1.0 + k % 3
    lap = np.diag(w.sum(1)) - w
    want = np.linalg.eigh(lap)[1][:, 1]
    monkeypatch.setattr(partition, "WHOLE", 10)
    assert abs(abs(want @ partition._second(lap)) - 1) < 1e-6
    assert np.isfinite(partition._second(np.zeros((12, 12)))).all()
    parts = partition.halves(w, np.ones(n), 4)
    assert np.bincount(parts).min() >= 33 and (w * (parts[:, None] != parts)).sum() < 0.2 * w.sum()


@pytest.mark.parametrize("order", ["NATURAL", "DEGREE"])
def test_large_blocks_are_aggregated_in_rounds(spark, monkeypatch, order):
    a = grid(spark, 6)[0]
    p = a.select("i").distinct().selectExpr("i", "cast(i % 2 as int) AS blk")
    small = sorted(map(tuple, aggregate.soc_aggregates(a, p, 0.05, "SOC2", order).collect()))
    monkeypatch.setattr(aggregate, "MAX_BLOCK", 3)
    monkeypatch.setattr(aggregate, "soc_block", None)  # no task for a block
    assert sorted(map(tuple, aggregate.soc_aggregates(a, p, 0.05, "SOC2", order).collect())) == small


def test_diagonal_block_solves_gather_no_block(spark, monkeypatch):
    from gridloom.operators import smooth

    monkeypatch.setattr(smooth, "factor_blocks", None)
    m = np.array([[4.0, 1.0, 2.0], [1.0, 0.0, 3.0], [0.5, 1.0, 5.0]])
    a, p = mat(spark, m), spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "i long, blk int")
    d, x = np.array([0.25, 1.0, 0.2]), np.array([1.0, 2.0, 3.0])
    off = np.array([[0, 0, 2.0], [0, 0, 3.0], [0.5, 1.0, 0]])
    got = column(BlockJacobi(Block("DIAG")).build(a, p).apply(vec(spark, x), sweeps=2), 3)
    assert np.allclose(got, d * (x - off @ (d * x)))


def test_close_vectors_hold_few_products(spark, monkeypatch):
    from gridloom.sources import tables

    rows = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(30)], "i long, e array<double>")
    whole = sorted(map(tuple, tables.close_vectors(rows, rows.where("i % 5 = 0"), 0.9).collect()))
    monkeypatch.setattr(tables, "CELLS", 7)
    assert sorted(map(tuple, tables.close_vectors(rows, rows.where("i % 5 = 0"), 0.9).collect())) == whole and whole


def test_products_leave_the_matrix_in_place(spark, tmp_path):
    from gridloom.scratch import cut_by
    from gridloom.sources import tables

    lines = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (2, 2), (3, 4), (None, 5), (None, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    a = cut_by(tables.laplacian(spark, str(tmp_path)), "j", dealt=True)
    want = {(1, 1): 4.0, (2, 2): 4.0, (3, 3): 3.0, (4, 4): 1.0, (5, 5): 1.0, (1, 2): -2.0, (2, 1): -2.0, (1, 3): -1.0, (3, 1): -1.0, (2, 3): -1.0, (3, 2): -1.0}
    assert {(r.i, r.j): r.v for r in a.collect()} == want
    y = blas.spmv(a, spark.range(1, 6).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the vector and the sums
    assert {r.v for r in y.collect()} == {1.0}


def test_small_blocks_are_solved_in_packs(spark):
    from gridloom.operators import smooth

    a = grid(spark, 6)[0]
    p = a.select("i").distinct().selectExpr("i", "cast((i - 1) div 4 as int) AS blk")
    s = BlockJacobi(Block("ILU")).build(blas.cut(a), p)
    x = a.select("i").distinct().withColumn("v", F.col("i") * 1.0)
    one = BlockJacobi(Block("ILU"))
    one.a, one.p, one.packs, one.diagonal, one.inverse, one.off, one.coupled = a, p, 1, None, None, s.off, True
    e = blas.block_of(a, p).where("bi = bj").select(F.col("bi").alias("blk"), "i", "j", "v")
    one.factors = smooth.factor_blocks(e, p, one.solver)
    assert s.factors.count() == 1 and one.factors.count() == 9
    for trans in "NT":
        assert np.allclose(column(s.apply(x, sweeps=2, trans=trans), 36), column(one.apply(x, sweeps=2, trans=trans), 36), rtol=1e-12)
    rows = lambda b: sorted((r.blk, r.kind, r.i, r.j, r.v) for r in b.dump()["factors"].collect())
    assert rows(s) == rows(one)


def test_filtered_smoothing_moves_an_entry_once(spark):
    from gridloom.scratch import cut_by

    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.5)
    m[np.arange(12), np.arange(12)] = rng.normal(size=12) * 4
    m[3, 3] = m[7, 7] = 0.0  # rows without a diagonal entry
    m[5] = 0.0
    m[5, 5] = 2.0
    p = np.zeros((12, 4))
    p[np.arange(12), np.arange(12) // 3] = 1.0
    p[4, 3], p[9] = -0.5, 0.0  # a row with two entries, and one with none
    a, pt = mat(spark, m), mat(spark, p)
    theta, w = 0.3, 0.5
    d = np.abs(m.diagonal())
    weak = ~np.eye(12, dtype=bool) & (np.abs(m) < theta * np.sqrt(np.outer(d, d)))
    f = np.where(weak, 0, m)
    f[np.arange(12), np.arange(12)] -= np.where(weak, m, 0).sum(1)
    r = np.where(f.diagonal() == 0, 1.0, 1.0 / np.where(f.diagonal() == 0, 1.0, f.diagonal()))
    want = (np.eye(12) - w * r[:, None] * f) @ p
    for one in (a, cut_by(a, "j")):
        assert np.allclose(dense(aggregate.smoothed(one, pt, theta, True, w), 12, 4), want)
    got = aggregate.smoothed(cut_by(mat(spark, m + np.diag(m.diagonal() == 0)), "j"), pt, theta, True, w)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(i#") <= 2 and plan.count("Exchange hashpartitioning(c#") == 0, plan
    assert "Exchange hashpartitioning(k#" not in plan


def test_written_tables_are_not_written_again(spark):
    from gridloom.scratch import cut_by

    a, _, p, m, _ = grid(spark, 4, count=2)
    byj = cut_by(a, "j")
    assert blas.cut(a) is a and blas.cut(byj) is byj and blas.cut(a.where("i > 0")) is not a
    pt = blas.cut(aggregate.tentative(p.select("i", F.expr("i div 4 + 1").alias("agg"))))
    pre = Preconditioner("ML").set("SMOOTHER_TYPE", "JACOBI").set_hierarchy(byj, p, [(pt, None)])
    assert pre.levels[0].a is byj
    q = dense(pt, 16, 5)
    assert np.allclose(dense(pre.levels[1].a, 5), q.T @ m @ q)


def test_jacobi_takes_its_rows_from_the_partition(spark):
    m = rand(6, 8)
    m[2, 2] = 0.0  # no diagonal: 1
    a, p = mat(spark, m), generators.blocks((spark, 6), 2)
    x = np.arange(1.0, 7.0)
    want = x / np.where(m.diagonal() == 0, 1.0, m.diagonal())
    for part in (p, None):
        s = Jacobi().build(a, part)
        assert np.allclose(column(s.apply(vec(spark, x)), 6), want)


def test_blocks_keep_their_rows_in_place(spark):
    a, _, p, _, _ = grid(spark, 5, count=2)
    local = aggregate._inside(a, p)
    rows = local.groupBy("blk", "i").agg(F.count("*").alias("n"), F.max(F.col("di") == 0).alias("none"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 25 and not rows.where("none").count()
    assert local.where("abs(di - dj) > 1e-12").count() == 0  # constant coefficients


def test_nothing_a_node_is_broadcast_by_the_partition(spark):
    from gridloom.operators import partition

    a, _, p, _, _ = grid(spark, 5, count=2)
    both = blas.cut(a.where("i <> j").select("i", "j", F.abs("v").alias("v")))
    for df in (graph.mutual_round(both), partition.cut_weight(a, p)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
