"""DuckDB statements for what runs in sequence: block solvers, aggregation, matching rounds and dense solves.

A block is a row with its matrix as a list of rows; a sweep or an elimination is ``list_reduce`` over these, each led by
its number.  So the statements follow the definitions row by row and share nothing with the engine.
"""

from __future__ import annotations

from gridloom.plans import sql as q


def matrices(name: str, members: str, entries: str) -> list[str]:
    """CTE ``name`` (blk, m, n, ids): dense rows of each block, led by their number from 1."""
    return [
        q.cte(f"{name}_k", f"SELECT blk, i, row_number() OVER (PARTITION BY blk ORDER BY i) AS r FROM {members}"),
        q.cte(f"{name}_r", f"SELECT x.blk, x.r, any_value(x.i) AS i, list_prepend(x.r::DOUBLE, list(coalesce(e.v, 0)::DOUBLE ORDER BY y.r)) AS row FROM {name}_k x JOIN {name}_k y ON y.blk = x.blk LEFT JOIN {entries} e ON e.blk = x.blk AND e.i = x.i AND e.j = y.i GROUP BY x.blk, x.r"),
        q.cte(name, f"SELECT blk, list(row ORDER BY r) AS m, count(*) AS n, list(i ORDER BY r) AS ids FROM {name}_r GROUP BY blk"),
    ]


def held(name: str, blocks: str, vector: str) -> str:
    """CTE ``name`` (blk, x): a vector by blocks, 0 where it has no entry."""
    return q.cte(name, f"SELECT k.blk, list(coalesce(v.v, 0)::DOUBLE ORDER BY k.r) AS x FROM {blocks}_k k LEFT JOIN {vector} v ON v.i = k.i GROUP BY k.blk")


def flat(name: str, solved: str, blocks: str, column: str = "y") -> str:
    """CTE ``name`` (blk, i, v) of a list by block."""
    return q.cte(name, f"SELECT blk, unnest(ids) AS i, unnest({column}) AS v FROM {solved} JOIN {blocks} USING (blk)")


_K = "CAST(w[1] AS BIGINT)"


def gauss_seidel(name: str, blocks: str, rhs: str, guess: str | None, backward: bool = False) -> str:
    """CTE ``name`` (blk, y): a sweep over the rows of each block."""
    rows = "list_reverse(m)" if backward else "m"
    start = f"(SELECT g.x FROM {guess} g WHERE g.blk = t.blk)" if guess else "list_transform(x, lambda u: 0::DOUBLE)"
    step = f"lambda y, w: list_transform(y, lambda u, c: CASE WHEN c = {_K} THEN (x[c] - list_dot_product(w[2:], y) + w[1 + c] * u) / w[1 + c] ELSE u END)"
    return q.cte(name, f"SELECT blk, list_reduce({rows}, {step}, y0) AS y FROM (SELECT t.blk, m, x, {start} AS y0 FROM {blocks} t JOIN {rhs} USING (blk))")


def direct(name: str, blocks: str, rhs: str) -> str:
    """CTE ``name`` (blk, y): Gauss-Jordan elimination without pivoting."""
    augmented = "list_transform(m, lambda w, r: list_append(w[2:], x[r]))"
    pivot = "list_transform(a[k[1][1]::BIGINT], lambda u: u / a[k[1][1]::BIGINT][k[1][1]::BIGINT])"
    step = f"lambda a, k: list_transform(a, lambda w, r: CASE WHEN r = k[1][1]::BIGINT THEN {pivot} ELSE list_transform(w, lambda u, c: u - w[k[1][1]::BIGINT] * a[k[1][1]::BIGINT][c] / a[k[1][1]::BIGINT][k[1][1]::BIGINT]) END)"
    return q.cte(name, f"SELECT blk, list_transform(list_reduce(list_transform(m, lambda w: [[w[1]]]), {step}, {augmented}), lambda w: w[n + 1]) AS y FROM {blocks} JOIN {rhs} USING (blk)")


#: The eliminated row ``w`` against an earlier row ``u`` of L and U: the factor, and the rest of the row.
_F = "w[1 + u[1]::BIGINT] / u[1 + u[1]::BIGINT]"


def ilu0(name: str, blocks: str, modified: bool = False) -> str:
    """CTE ``name`` (blk, f): L without its diagonal and U in one list of rows, on the pattern of the matrix."""
    lost = f" - CASE WHEN c = 1 + w[1]::BIGINT THEN {_F} * list_sum(list_transform(u, lambda z, s: CASE WHEN s > 1 + u[1]::BIGINT AND o[1][s] = 0 AND s <> 1 + w[1]::BIGINT THEN z ELSE 0 END)) ELSE 0 END" if modified else ""
    row = f"list_transform(w, lambda z, c: CASE WHEN c = 1 + u[1]::BIGINT THEN {_F} WHEN c > 1 + u[1]::BIGINT AND (o[1][c] <> 0 OR c = 1 + w[1]::BIGINT) THEN z - {_F} * u[c]{lost} ELSE z END)"
    return q.cte(name, f"SELECT blk, list_reduce(list_transform(m, lambda w: [w]), lambda done, o: list_append(done, list_reduce(done, lambda w, u: CASE WHEN w[1 + u[1]::BIGINT] = 0 THEN w ELSE {row} END, o[1])), []::DOUBLE[][]) AS f FROM {blocks}")


def ilut(name: str, blocks: str, fill: int, tol: float) -> str:
    """CTE ``name`` (blk, f): threshold factors; on either side the row's own number of entries and ``fill`` more stay."""
    bar = f"({tol!r} * sqrt(list_sum(list_transform(o[1][2:], lambda z: z * z))))"
    row = f"list_transform(w, lambda z, c: CASE WHEN c = 1 + u[1]::BIGINT THEN CASE WHEN abs({_F}) < {bar} THEN 0 ELSE {_F} END WHEN c > 1 + u[1]::BIGINT AND abs({_F}) >= {bar} THEN z - {_F} * u[c] ELSE z END)"
    made = f"list_reduce(done, lambda w, u: CASE WHEN w[1 + u[1]::BIGINT] = 0 THEN w ELSE {row} END, o[1])"

    def least(side: str) -> str:
        own = f"list_sum(list_transform(o[1], lambda z, c: CASE WHEN {side} AND z <> 0 THEN 1 ELSE 0 END))"
        sizes = f"list_reverse_sort(list_transform(v[1], lambda z, c: CASE WHEN {side} AND abs(z) >= {bar} THEN abs(z) ELSE 0 END))"
        return f"{sizes}[({own} + {fill})::BIGINT]"

    low, up = "c > 1 AND c <= o[1][1]::BIGINT", "c > 1 + o[1][1]::BIGINT"
    kept = f"list_transform(v[1], lambda z, c: CASE WHEN c = 1 OR c = 1 + o[1][1]::BIGINT THEN z WHEN abs(z) < {bar} THEN 0 WHEN {low} AND abs(z) >= {least(low)} THEN z WHEN {up} AND abs(z) >= {least(up)} THEN z ELSE 0 END)"
    return q.cte(name, f"SELECT blk, list_reduce(list_transform(m, lambda w: [w]), lambda done, o: list_concat(done, list_transform([[{made}]], lambda v: {kept})), []::DOUBLE[][]) AS f FROM {blocks}")


def lu_solve(name: str, factors: str, rhs: str) -> str:
    """CTE ``name`` (blk, y): the triangles of ``f`` solved one after the other."""
    fore = f"lambda y, w: list_transform(y, lambda u, c: CASE WHEN c = {_K} THEN u - coalesce(list_sum(list_transform(y[1:c - 1], lambda z, s: z * w[1 + s])), 0) ELSE u END)"
    back = f"lambda y, w: list_transform(y, lambda u, c: CASE WHEN c = {_K} THEN (u - coalesce(list_sum(list_transform(y, lambda z, s: CASE WHEN s > c THEN z * w[1 + s] ELSE 0 END)), 0)) / w[1 + c] ELSE u END)"
    return q.cte(name, f"SELECT blk, list_reduce(list_reverse(f), {back}, list_reduce(f, {fore}, x)) AS y FROM {factors} JOIN {rhs} USING (blk)")


def inverse_first_order(name: str, factors: str, rhs: str) -> str:
    """CTE ``name`` (blk, y): (I - D U) D (I - L) x, the inverses of the triangles without fill."""
    lower = "list_transform(x, lambda u, c: u - coalesce(list_sum(list_transform(x[1:c - 1], lambda z, s: z * f[c][1 + s])), 0))"
    scaled = "list_transform(t, lambda u, c: u / f[c][1 + c])"
    out = "list_transform(s, lambda u, c: u - list_sum(list_transform(s, lambda z, k: CASE WHEN k > c THEN z * f[c][1 + k] ELSE 0 END)) / f[c][1 + c])"
    return q.cte(name, f"SELECT blk, {out} AS y FROM (SELECT blk, f, {scaled} AS s FROM (SELECT blk, f, {lower} AS t FROM {factors} JOIN {rhs} USING (blk)))")


def _unit_inverse(rows: str, tol: float) -> str:
    """Rows of the inverse of a unit lower triangle (its strict part in rows led by their number), small entries dropped."""
    start = "list_transform(o[1], lambda z, c: CASE WHEN c = 1 THEN z WHEN c = 1 + o[1][1]::BIGINT THEN 1 ELSE 0 END)"
    made = f"list_reduce(done, lambda w, u: CASE WHEN o[1][1 + u[1]::BIGINT] = 0 THEN w ELSE list_transform(w, lambda z, c: CASE WHEN c = 1 THEN z ELSE z - o[1][1 + u[1]::BIGINT] * u[c] END) END, {start})"
    kept = f"list_transform({made}, lambda z, c: CASE WHEN c <= 1 OR c = 1 + o[1][1]::BIGINT OR abs(z) >= {tol!r} THEN z ELSE 0 END)"
    return f"list_reduce(list_transform({rows}, lambda w: [w]), lambda done, o: list_append(done, {kept}), []::DOUBLE[][])"


def inverse_by_threshold(name: str, factors: str, rhs: str, tol: float) -> str:
    """CTE ``name`` (blk, y): Z D W x with W and Z the inverses of L and of the transposed unit U, dropped at ``tol``."""
    low = "list_transform(f, lambda w: list_transform(w, lambda z, c: CASE WHEN c = 1 OR c <= w[1]::BIGINT THEN z ELSE 0 END))"
    up = "list_transform(f, lambda w, r: list_prepend(w[1], list_transform(f, lambda u, k: CASE WHEN k < r THEN u[1 + r] / u[1 + k] ELSE 0 END)))"
    inner = f"SELECT blk, f, x, {_unit_inverse(low, tol)} AS w, {_unit_inverse(up, tol)} AS z FROM {factors} JOIN {rhs} USING (blk)"
    y = "list_transform(w, lambda u, r: list_dot_product(u[2:], x) / f[r][1 + r])"
    out = "list_transform(y, lambda u, c: list_sum(list_transform(z, lambda w, k: w[1 + c] * y[k])))"
    return q.cte(name, f"SELECT blk, {out} AS y FROM (SELECT blk, z, {y} AS y FROM ({inner}))")


def biconjugation(name: str, blocks: str, rhs: str, tol: float) -> str:
    """CTE ``name`` (blk, y): Z D^-1 W^T x of left-looking biconjugation; a vector is led by its number and pivot.

    State of a step: [number, pivot, z, w, w^T A, A z] in one list of 2 + 4 n numbers.
    """
    unit = "list_transform(range(1, n + 1), lambda c: CASE WHEN c = o[1][1]::BIGINT THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    part = lambda k: f"[2 + {k} * n + 1 : 2 + {k + 1} * n]"
    less = lambda along, by: f"list_reduce(list_transform(done, lambda s: s), lambda v, s: list_transform(v, lambda z, c: z - list_dot_product(s{part(along)}, v) / s[2] * s[2 + {by} * n + c]), {unit})"
    drop = lambda v: f"list_transform({v}, lambda z, c: CASE WHEN c = o[1][1]::BIGINT OR abs(z) >= {tol!r} THEN z ELSE 0 END)"
    z, w = drop(less(2, 0)), drop(less(3, 1))
    times = "list_transform(range(1, n + 1), lambda c: list_sum(list_transform(p[2], lambda u, r: u * m[r][1 + c])))"
    after = "list_transform(m, lambda u: list_dot_product(u[2:], p[1]))"
    step = f"list_transform([[{z}, {w}]], lambda p: list_concat([o[1][1], list_dot_product(o[1][2:], p[1])], p[1], p[2], {times}, {after}))"
    inner = f"SELECT blk, n, x, list_reduce(list_transform(m, lambda w: [w]), lambda done, o: list_concat(done, {step}), []::DOUBLE[][]) AS st FROM {blocks} JOIN {rhs} USING (blk)"
    y = f"list_transform(st, lambda s: list_dot_product(s{part(1)}, x) / s[2])"
    return q.cte(name, f"SELECT blk, list_transform(range(1, n + 1), lambda c: list_sum(list_transform(st, lambda s, k: s[2 + c] * y[k]))) AS y FROM (SELECT blk, n, st, {y} AS y FROM ({inner}))")


def block_sweeps(skew: float, solver, guessed: bool = False, l1: bool = False, factors=None) -> str:
    """Two sweeps of block Jacobi on the shelves; ``solver(name, blocks or factors, rhs, guess)`` is a CTE."""
    out = [*q.shelf(skew), q.cte("ab", "SELECT a.i, a.j, a.v, x.blk, y.blk AS bj FROM a JOIN p x ON x.i = a.i JOIN p y ON y.i = a.j")]
    moved = "SELECT blk, i, i AS j, sum(abs(v)) AS v FROM ab WHERE blk <> bj GROUP BY blk, i"
    inside, off = "SELECT blk, i, j, v FROM ab WHERE blk = bj", "SELECT i, j, v FROM ab WHERE blk <> bj"
    if l1:
        inside, off = f"SELECT blk, i, j, sum(v) AS v FROM ({inside} UNION ALL {moved}) GROUP BY ALL", f"{off} UNION ALL SELECT i, j, -v FROM ({moved})"
    out += [q.cte("ins", inside), q.cte("off", off), *matrices("bm", "p", "ins"), held("x1", "bm", "b")]
    if factors:
        out.append(factors("bf", "bm"))
    base = "bf" if factors else "bm"
    out += [solver("s1", base, "x1", None), flat("y1", "s1", "bm"), q.spmv("po", "off", "y1"), q.lin("r2", (1, "b"), (-1, "po")), held("x2", "bm", "r2")]
    guess = "g1" if guessed else None
    if guessed:
        out.append(held("g1", "bm", "y1"))
    out += [solver("s2", base, "x2", guess), flat("y2", "s2", "bm")]
    return q.with_(*out) + q.vector("y2", 6)


def schwarz(restricted: bool, how: str = "sum") -> str:
    """One additive Schwarz step with incomplete LU on blocks with one layer of overlap."""
    out = [*q.shelf(), q.cte("o", "SELECT DISTINCT p.blk, a.j AS i FROM p JOIN a ON a.i = p.i"), q.cte("ins", "SELECT o.blk, a.i, a.j, a.v FROM o JOIN a ON a.i = o.i")]
    out += [*matrices("bm", "o", "ins"), held("x1", "bm", "b"), ilu0("bf", "bm"), lu_solve("s1", "bf", "x1"), flat("y1", "s1", "bm")]
    out.append(q.cte("y", "SELECT y1.i, y1.v FROM y1 JOIN p ON p.i = y1.i AND p.blk = y1.blk" if restricted else f"SELECT i, {how}(v) AS v FROM y1 GROUP BY i"))
    return q.with_(*out) + q.vector("y", 6)


def factor_entries(skew: float) -> str:
    """L, pivots and U of the blocks as entries."""
    out = [*q.shelf(skew), q.cte("ins", "SELECT x.blk, a.i, a.j, a.v FROM a JOIN p x ON x.i = a.i JOIN p y ON y.i = a.j AND y.blk = x.blk"), *matrices("bm", "p", "ins"), ilu0("bf", "bm")]
    out.append(q.cte("fr", "SELECT blk, ids, unnest(f) AS w FROM bf JOIN bm USING (blk)"))
    out.append(q.cte("fe", "SELECT blk, ids[w[1]::BIGINT] AS i, unnest(ids) AS j, unnest(w[2:]) AS v FROM fr"))
    return q.with_(*out) + "SELECT blk::INTEGER AS blk, CASE WHEN j < i THEN 'l' WHEN j = i THEN 'd' ELSE 'u' END AS kind, i, j, round(v, 8) AS v FROM fe WHERE v <> 0"


def remapped(skew: float) -> str:
    """Blocks after one round of pairing by the weight between them."""
    out = [*q.shelf(skew), q.cte("be", "SELECT least(x.blk, y.blk) AS i, greatest(x.blk, y.blk) AS j, sum(abs(a.v)) AS v FROM a JOIN p x ON x.i = a.i JOIN p y ON y.i = a.j WHERE x.blk <> y.blk GROUP BY ALL"), q.cte("bb", "SELECT i, j, v FROM be UNION ALL SELECT j, i, v FROM be")]
    out += matched("bb", 20)
    return q.with_(*out) + "SELECT p.i, coalesce(pairs.i, p.blk)::INTEGER AS blk FROM p LEFT JOIN pairs ON pairs.j = p.blk"


def complex_solution(digits: int, sweeps: int = 400) -> str:
    """The solution of the shelves with an imaginary diagonal: Jacobi sweeps on real and imaginary parts."""
    out = [*q.shelf(), q.cte("im", "SELECT i, size / 5.0::DOUBLE AS s FROM pn"), q.D,
           q.cte("dd", "SELECT d.i, d.v / (d.v * d.v + s * s) AS re, -s / (d.v * d.v + s * s) AS im FROM d JOIN im ON im.i = d.i"), q.cte("od", "SELECT i, j, v FROM a WHERE i <> j"), q.cte("bc", "SELECT b.i, b.v AS re, b.v * 0.5 AS im FROM b")]
    r, m = "(any_value(bc.re) - sum(od.v * y.re))", "(any_value(bc.im) - sum(od.v * y.im))"
    walk = f"y(k, i, re, im) AS (SELECT 0, i, 0.0::DOUBLE, 0.0::DOUBLE FROM bc UNION ALL SELECT any_value(y.k) + 1, bc.i, {r} * any_value(dd.re) - {m} * any_value(dd.im), {r} * any_value(dd.im) + {m} * any_value(dd.re) FROM y JOIN od ON od.j = y.i JOIN bc ON bc.i = od.i JOIN dd ON dd.i = od.i WHERE y.k < {sweeps} GROUP BY bc.i)"
    return q.with_(*out).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + walk + f"\nSELECT i, round(re, {digits}) AS re, round(im, {digits}) AS im FROM y WHERE k = {sweeps}"


def solution(skew: float, digits: int, sweeps: int = 400) -> str:
    """The solution of the system on the shelves: Jacobi sweeps in a recursive statement, which halve the error or better in three."""
    out = [*q.shelf(skew), q.D, q.cte("od", "SELECT a.i, a.j, a.v / d.v AS v FROM a JOIN d ON d.i = a.i WHERE a.i <> a.j"), q.cte("s", "SELECT b.i, b.v / d.v AS v FROM b JOIN d ON d.i = b.i")]
    walk = f"y(k, i, v) AS (SELECT 0, i, v FROM s UNION ALL SELECT any_value(y.k) + 1, s.i, any_value(s.v) - sum(od.v * y.v) FROM y JOIN od ON od.j = y.i JOIN s ON s.i = od.i WHERE y.k < {sweeps} GROUP BY s.i)"
    return q.with_(*out).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + walk + f"\nSELECT i, round(v, {digits}) AS v FROM y WHERE k = {sweeps}"


def _first_set(name: str, nodes: str, before: str, rounds: int) -> list[str]:
    """CTE ``name`` (i): the set that taking ``nodes`` in turn gives, where ``before`` (i, k, earlier) says that i rules out k.

    In rounds: a node that no earlier open node rules out is in.  Nodes open after ``rounds`` count as in, which shows.
    """
    out, live = [], nodes
    for r in range(rounds):
        out.append(q.cte(f"{name}i{r}", f"SELECT i FROM {live} ANTI JOIN (SELECT b.k FROM {before} b JOIN {live} x ON x.i = b.i WHERE b.earlier) t ON t.k = {live}.i"))
        out.append(q.cte(f"{name}u{r}", f"SELECT i FROM {live} ANTI JOIN (SELECT i AS k FROM {name}i{r} UNION ALL SELECT b.k FROM {before} b JOIN {name}i{r} x ON x.i = b.i) t ON t.k = {live}.i"))
        live = f"{name}u{r}"
    return [*out, q.cte(name, " UNION ALL ".join(f"SELECT i FROM {name}i{r}" for r in range(rounds)) + f" UNION ALL SELECT i FROM {live}")]


def aggregates(prefix: list[str], theta: float, second: bool = False, by_degree: bool = False, by_hash: bool = False, rounds: int = 40) -> list[str]:
    """CTEs up to ``roots`` (i) and ``agg`` (i, agg): strength-based aggregation of ``a`` (i, j, v) on blocks ``p``.

    Phase one: roots are nodes whose strong neighbourhood no earlier root's meets.  Phase two: the others join their
    strongest neighbour of the first phase.  Phase three: what is left opens aggregates in turn.
    """
    strong = f"s > 0 AND abs(v) / s >= {theta}" if second else f"abs(v) > {theta} * s"
    coupling = "CASE WHEN s > 0 THEN abs(v) / s ELSE 0 END" if second else "abs(v)"
    spread = "(i % 4294967296 * 1540483477 % 4294967296)"
    order = "deg DESC, i" if by_degree else f"xor({spread}, {spread} >> 15) * 1540483477 % 4294967296, i" if by_hash else "i"
    return [
        *prefix,
        q.cte("lo", "SELECT a.i, a.j, a.v, x.blk FROM a JOIN p x ON x.i = a.i JOIN p y ON y.i = a.j AND y.blk = x.blk"),
        q.cte("ld", "SELECT i, sum(CASE WHEN i = j THEN v ELSE 0 END) AS d FROM lo GROUP BY i"),
        q.cte("no", f"SELECT blk, i, deg, row_number() OVER (PARTITION BY blk ORDER BY {order}) AS turn FROM (SELECT blk, i, count(*) AS deg FROM lo GROUP BY blk, i)"),
        q.cte("ne", f"SELECT i, j, {coupling} AS c, {strong} AS strong FROM (SELECT lo.*, sqrt(abs(g.d * h.d)) AS s FROM lo JOIN ld g ON g.i = lo.i JOIN ld h ON h.i = lo.j)"),
        q.cte("sr", "SELECT i, j FROM ne WHERE strong UNION SELECT i, i FROM no"),
        q.cte("cf", "SELECT DISTINCT x.i, y.i AS k, g.turn < h.turn AS earlier FROM sr x JOIN sr y ON y.j = x.j AND y.i <> x.i JOIN no g ON g.i = x.i JOIN no h ON h.i = y.i"),
        q.cte("can", "SELECT i FROM no" + (" WHERE deg > 1" if second else "")),
        *_first_set("roots", "can", "cf", rounds),
        q.cte("f1", "SELECT sr.j AS i, r.num FROM sr JOIN (SELECT i, row_number() OVER (PARTITION BY blk ORDER BY turn) AS num FROM no SEMI JOIN roots USING (i)) r ON r.i = sr.i"),
        q.cte("jo", "SELECT ne.i, arg_min(f1.num, {'c': -ne.c, 'j': ne.j}) AS num FROM ne JOIN f1 ON f1.i = ne.j JOIN no ON no.i = ne.i AND no.deg > 1 WHERE ne.strong AND ne.c > 0 AND ne.i NOT IN (SELECT i FROM f1) GROUP BY ne.i"),
        q.cte("f2", "SELECT * FROM f1 UNION ALL SELECT * FROM jo"),
        q.cte("re", "SELECT no.* FROM no ANTI JOIN f2 USING (i)" + (" WHERE no.deg > 1" if second else "")),
        q.cte("gr", "SELECT ne.i, ne.j AS k, x.turn < y.turn AS earlier FROM ne JOIN re x ON x.i = ne.i JOIN re y ON y.i = ne.j WHERE ne.i <> ne.j AND x.deg > 1" + ("" if second else " AND ne.strong")),
        q.cte("ca", "SELECT i FROM re WHERE deg > 1"),
        *_first_set("op", "ca", "gr", rounds),
        q.cte("of", "SELECT re.i, re.turn, re.blk, n1.n + row_number() OVER (PARTITION BY re.blk ORDER BY re.turn) AS num FROM re SEMI JOIN op USING (i) JOIN (SELECT blk, count(*) FILTER (i IN (SELECT i FROM roots)) AS n FROM no GROUP BY blk) n1 ON n1.blk = re.blk"),
        q.cte("f3", "SELECT * FROM f2 UNION ALL SELECT i, num FROM of UNION ALL SELECT gr.k AS i, arg_min(of.num, of.turn) AS num FROM gr JOIN of ON of.i = gr.i WHERE gr.k NOT IN (SELECT i FROM of) GROUP BY gr.k"),
        q.cte("ba", "SELECT blk, sum(n) OVER (ORDER BY blk) - n AS base FROM (SELECT no.blk, max(f3.num) AS n FROM f3 JOIN no USING (i) GROUP BY no.blk)"),
        q.cte("agg", "SELECT f3.i, (f3.num + ba.base)::BIGINT AS agg FROM f3 JOIN no USING (i) JOIN ba ON ba.blk = no.blk"),
    ]


def matched(edges: str, rounds: int) -> list[str]:
    """CTEs up to ``pairs`` (i, j): rounds of mutual best edges of ``edges`` (i, j, v), both directions given."""
    out, live = [], edges
    for k in range(rounds):
        out.append(q.cte(f"mb{k}", f"SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY v DESC, j DESC) AS k FROM {live}) WHERE k = 1"))
        out.append(q.cte(f"mp{k}", f"SELECT x.i, x.j FROM mb{k} x JOIN mb{k} y ON x.j = y.i AND y.j = x.i"))
        out.append(q.cte(f"ml{k}", f"SELECT l.* FROM {live} l ANTI JOIN mp{k} x ON x.i = l.i ANTI JOIN mp{k} y ON y.i = l.j"))
        live = f"ml{k}"
    out.append(q.cte("pairs", " UNION ALL ".join(f"SELECT i, j FROM mp{k} WHERE i < j" for k in range(rounds))))
    # An edge that is left would be a pair too many, which shows as a difference.
    return [*out, q.cte("left_over", f"SELECT i, j FROM {live}")]


def hierarchy(levels: int, theta: float = 0.01) -> list[str]:
    """CTEs ``a1``, ``t1``, ``pr1``, ``a2`` ... of a multilevel hierarchy: aggregates, smoothed prolongators, products."""
    out = [*q.shelf(), q.cte("a1", "SELECT * FROM a"), q.cte("p1", "SELECT * FROM p")]
    for k in range(1, levels):
        inner = q.with_(*aggregates([q.cte("a", f"SELECT * FROM a{k}"), q.cte("p", f"SELECT * FROM p{k}")], theta, rounds=24))
        out += [
            q.cte(f"t{k}", inner + "SELECT i, agg AS j, 1.0::DOUBLE AS v FROM agg"),
            q.cte(f"d{k}", f"SELECT i, sum(CASE WHEN i = j THEN v ELSE 0 END) AS v, sum(abs(v)) AS s FROM a{k} GROUP BY i"),
            q.cte(f"s{k}", f"SELECT m.i, m.j, (CASE WHEN m.i = m.j THEN 1 ELSE 0 END) - w.w * m.v / d.v AS v FROM a{k} m JOIN d{k} d ON d.i = m.i, (SELECT 4.0 / (3.0 * max(abs(s / v))) AS w FROM d{k}) w"),
            q.spgemm(f"pr{k}", f"s{k}", f"t{k}"),
            q.spgemm(f"ap{k}", f"a{k}", f"pr{k}"),
            q.spgemm(f"a{k + 1}", f"pr{k}", f"ap{k}", True),
            q.cte(f"p{k + 1}", f"SELECT t.j AS i, min(p.blk) AS blk FROM t{k} t JOIN p{k} p ON p.i = t.i GROUP BY t.j"),
        ]
    return out


class _Cycle:
    """Writes the CTEs of one cycle, visit by visit."""

    def __init__(self, how: str, levels: int):
        self.how, self.levels, self.out, self.n = how, levels, [], 0
        self.out.append(q.cte("cl", f"SELECT 0 AS blk, i, j, v FROM a{levels}"))
        self.out += matrices("cm", f"(SELECT DISTINCT 0 AS blk, i FROM a{levels})", "cl")
        self.out += [q.cte(f"l{k}", f"SELECT i, 1 / sum(CASE WHEN i = j THEN v ELSE abs(v) END) AS v FROM a{k} GROUP BY i") for k in range(1, levels)]

    def add(self, make, *args) -> str:
        self.n += 1
        self.out.append(make(f"z{self.n}", *args))
        return f"z{self.n}"

    def less(self, x: str, a: str, y: str) -> str:
        return self.add(q.lin, (1, x), (-1, self.add(q.spmv, a, y)))

    def smoothed(self, k: int, x: str, y: str | None) -> str:
        if y is None:
            return self.add(q.mlt, f"l{k}", x)
        return self.add(q.lin, (1, y), (1, self.add(q.mlt, f"l{k}", self.less(x, f"a{k}", y))))

    def dot(self, x: str, y: str) -> str:
        return f"(SELECT sum(g.v * h.v) FROM {x} g JOIN {y} h ON h.i = g.i)"

    def visit(self, k: int, x: str) -> str:
        if k == self.levels:
            return self.add(flat, self.add(direct, "cm", self.add(held, "cm", x)), "cm")
        y = self.smoothed(k, x, None)
        if self.how == "ADD":
            return self.add(q.lin, (1, y), (1, self.add(q.spmv, f"pr{k}", self.visit(k + 1, self.add(q.spmv, f"pr{k}", x, True)))))
        r = self.add(q.spmv, f"pr{k}", self.less(x, f"a{k}", y), True)
        if self.how.startswith("KCYCLE") and k <= self.levels - 2:
            z = self.inner(k + 1, r)
        else:
            z = self.visit(k + 1, r)
            if self.how == "WCYCLE" and k < self.levels - 1:
                z = self.add(q.lin, (1, z), (1, self.visit(k + 1, self.less(r, f"a{k + 1}", z))))
        return self.smoothed(k, x, self.add(q.lin, (1, y), (1, self.add(q.spmv, f"pr{k}", z))))

    def inner(self, k: int, w: str) -> str:
        """At most two Krylov steps; both are written, and the second counts where the first is not enough."""
        value = lambda e: self.add(lambda name: q.cte(name, f"SELECT {e} AS s"))
        of = lambda name: f"(SELECT s FROM {name})"
        symmetric = self.how == "KCYCLESYM"
        d0 = self.visit(k, w)
        v = self.add(q.spmv, f"a{k}", d0)
        lead = d0 if symmetric else v
        tau = value(self.dot(lead, v))
        alpha = value(f"{self.dot(lead, w)} / {of(tau)}")
        w1 = self.add(q.lin, (1, w), (f"-{of(alpha)}", v))
        d1 = self.visit(k, w1)
        v1 = self.add(q.spmv, f"a{k}", d1)
        lead = d1 if symmetric else v1
        t1, t2, t3 = (value(self.dot(lead, x)) for x in (v, v1, w1))
        t4 = value(f"{of(t2)} - {of(t1)} * {of(t1)} / {of(tau)}")
        enough = value(f"sqrt({self.dot(w1, w1)}) <= 0.25 * sqrt({self.dot(w, w)})")
        c0 = value(f"CASE WHEN {of(enough)} THEN {of(alpha)} ELSE {of(alpha)} - {of(t1)} * {of(t3)} / ({of(tau)} * {of(t4)}) END")
        c1 = value(f"CASE WHEN {of(enough)} THEN 0 ELSE {of(t3)} / {of(t4)} END")
        return self.add(q.lin, (of(c0), d0), (of(c1), d1))


def cycle(levels: int, how: str) -> str:
    """One cycle with l1-Jacobi smoothing and an exact coarsest solve for the right-hand side of the shelves."""
    c = _Cycle(how, levels)
    y = c.visit(1, "b")
    return q.with_(*hierarchy(levels), *c.out) + q.vector(y, 6)


def dumped(levels: int) -> str:
    """The matrices of all levels as (lev, kind, i, j, v)."""
    parts = []
    for k in range(1, levels + 1):
        parts.append(f"SELECT {k}::INTEGER AS lev, 'ac' AS kind, i, j, v FROM a{k}")
        if k < levels:
            parts += [f"SELECT {k}, 'p', i, j, v FROM pr{k}", f"SELECT {k}, 'r', j, i, v FROM pr{k}", f"SELECT {k}, 'tprol', i, j, v FROM t{k}"]
    return q.with_(*hierarchy(levels)) + f"SELECT lev, kind, i, j, round(v, 8) AS v FROM ({' UNION ALL '.join(parts)}) WHERE abs(v) > 1e-7"


def coupled(sweeps: int) -> str:
    """The prolongator of ``sweeps`` of pairwise matching with the vector of ones, as entries (i, j, v)."""
    eps = "2.220446049250313e-16"
    out = [*q.shelf(), q.cte("a1", "SELECT * FROM a"), q.cte("w1", "SELECT i, 1.0::DOUBLE AS v FROM a GROUP BY i")]
    for k in range(1, sweeps + 1):
        den = "(x.v * u.v * u.v + y.v * w.v * w.v)"
        inner = q.with_(q.cte("both_", f"SELECT i, j, v FROM e{k} UNION ALL SELECT j, i, v FROM e{k}"), *matched("both_", 40))
        out += [
            q.cte(f"dg{k}", f"SELECT i, sum(CASE WHEN i = j THEN v ELSE 0 END) AS v FROM a{k} GROUP BY i"),
            q.cte(f"c{k}", f"SELECT m.i, m.j, CASE WHEN {den} <= {eps} THEN {eps} ELSE 1 - 2 * m.v * u.v * w.v / {den} END AS c FROM a{k} m JOIN dg{k} x ON x.i = m.i JOIN dg{k} y ON y.i = m.j JOIN w{k} u ON u.i = m.i JOIN w{k} w ON w.i = m.j WHERE m.i < m.j"),
            q.cte(f"e{k}", f"SELECT i, j, round(ln(abs(c) / (0.999 * (SELECT min(abs(c)) FROM c{k} WHERE c <> 0))), 10) AS v FROM c{k} WHERE c <> 0"),
            q.cte(f"m{k}", inner + "SELECT i, j FROM pairs UNION ALL SELECT i, j FROM left_over"),
            q.cte(f"o{k}", f"SELECT g.i, coalesce(p.own, g.i) AS own FROM dg{k} g LEFT JOIN (SELECT i AS own, i FROM m{k} UNION ALL SELECT i, j FROM m{k}) p ON p.i = g.i"),
            q.cte(f"pt{k}", f"SELECT o.i, o.own AS j, w.v / sqrt(sum(w.v * w.v) OVER (PARTITION BY o.own)) AS v FROM o{k} o JOIN w{k} w ON w.i = o.i WHERE abs(w.v) > 1e-15"),
            q.spmv(f"w{k + 1}", f"pt{k}", f"w{k}", True),
            q.spgemm(f"ap{k}", f"a{k}", f"pt{k}"),
            q.spgemm(f"a{k + 1}", f"pt{k}", f"ap{k}", True),
        ]
        out.append(q.cte("pr1", "SELECT * FROM pt1") if k == 1 else q.spgemm(f"pr{k}", f"pr{k - 1}", f"pt{k}"))
    return q.with_(*out) + q.matrix(f"pr{sweeps}", 9)
