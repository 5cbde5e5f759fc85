"""Pieces of DuckDB SQL from which the statements equivalent to the registered queries are put together."""

from __future__ import annotations

from gridloom.functions.coefficients import SETS_2D, SETS_3D


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


B = cte("bm", "SELECT DISTINCT l_orderkey AS i, l_partkey AS j, 1.0::DOUBLE AS v FROM lineitem")
W = cte("wm", "SELECT x.j AS i, y.j AS j, count(*)::DOUBLE AS v FROM bm x JOIN bm y ON x.i = y.i AND x.j <> y.j GROUP BY ALL")
L = cte("a", "SELECT i, j, -v AS v FROM wm UNION ALL SELECT n.j AS i, n.j AS j, coalesce(sum(w.v), 0) + 1 AS v FROM (SELECT DISTINCT j FROM bm) n LEFT JOIN wm w ON w.i = n.j GROUP BY ALL")
LAP = (B, W, L)
X = cte("x", "SELECT p_partkey AS i, p_retailprice AS v FROM part")
S = cte("s", "SELECT l_suppkey AS i, l_partkey AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL")
T = (
    cte("pairs", "SELECT event_type AS e, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"),
    cte("names", "SELECT event_type AS e, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)"),
    cte("t", "SELECT a.k AS i, b.k AS j, count(*)::DOUBLE AS v FROM pairs p JOIN names a ON a.e = p.e JOIN names b ON b.e = p.n GROUP BY ALL"),
)
D = cte("d", "SELECT i, sum(CASE WHEN i = j THEN v ELSE 0 END) AS v FROM a GROUP BY i")
DI = cte("di", "SELECT i, CASE WHEN v = 0 THEN 1 ELSE 1 / v END AS v FROM d")
SC = cte("sc", "SELECT a.i, a.j, a.v, sqrt(abs(di0.v * dj0.v)) AS s FROM a JOIN d di0 ON di0.i = a.i JOIN d dj0 ON dj0.i = a.j")
PT = cte("pt", "SELECT i, i // 4 + 1 AS j, 1.0::DOUBLE AS v FROM d")


def spmv(name: str, a: str, x: str, trans: bool = False) -> str:
    r, c = ("j", "i") if trans else ("i", "j")
    return cte(name, f"SELECT m.{r} AS i, sum(m.v * x.v) AS v FROM {a} m JOIN {x} x ON x.i = m.{c} GROUP BY m.{r}")


def lin(name: str, *terms: tuple[float, str]) -> str:
    union = " UNION ALL ".join(f"SELECT i, {k} * v AS v FROM {t}" for k, t in terms)
    return cte(name, f"SELECT i, sum(v) AS v FROM ({union}) GROUP BY i")


def mlt(name: str, d: str, x: str) -> str:
    return cte(name, f"SELECT x.i, d.v * x.v AS v FROM {d} d JOIN {x} x ON x.i = d.i")


def spgemm(name: str, a: str, b: str, trans_a: bool = False) -> str:
    r, c = ("j", "i") if trans_a else ("i", "j")
    return cte(name, f"SELECT m.{r} AS i, n.j AS j, sum(m.v * n.v) AS v FROM {a} m JOIN {b} n ON n.i = m.{c} GROUP BY ALL")


def jacobi(prefix: str, a: str, di: str, x: str, sweeps: int, start: str | None = None) -> list[str]:
    """CTEs of sweeps y <- y + D^-1 (x - A y); the last is ``prefix``<sweeps>."""
    out, y = [], start
    for k in range(1, sweeps + 1):
        if y is None:
            out.append(mlt(f"{prefix}{k}", di, x))
        else:
            out += [spmv(f"{prefix}p{k}", a, y), lin(f"{prefix}r{k}", (1, x), (-1, f"{prefix}p{k}")), mlt(f"{prefix}c{k}", di, f"{prefix}r{k}"), lin(f"{prefix}{k}", (1, y), (1, f"{prefix}c{k}"))]
        y = f"{prefix}{k}"
    return out


def vector(name: str, digits: int = 4) -> str:
    return f"SELECT i, round(v, {digits}) AS v FROM {name}"


def matrix(name: str, digits: int = 6) -> str:
    return f"SELECT i, j, round(v, {digits}) AS v FROM {name}"


def stencil(dim: int, kind: str) -> tuple[str, str]:
    """Statements for the matrix and the right-hand side of a generated problem with the parts as nodes."""
    s = (SETS_2D if dim == 2 else SETS_3D)[kind]
    fix = lambda e: e.replace("EPS", repr(s["eps"])).replace("0D", "0.0::DOUBLE").replace("1.414D", "1.414::DOUBLE").replace("1D", "1.0::DOUBLE").replace("2D", "2.0::DOUBLE").replace("3D", "3.0::DOUBLE")
    a, b, c, axes = fix(s["a"]), [fix(e) for e in s["b"]], fix(s["c"]), "xyz"[:dim]
    power = lambda k: "*".join(["m"] * k) or "1"
    side = "sqrt" if dim == 2 else "cbrt"
    size = cte("g", f"SELECT floor({side}(count(*)) + 1e-9)::BIGINT AS m FROM part")
    coords = ", ".join(f"(p_partkey // ({power(dim - 1 - n)})) % m + 1 AS i{k}" for n, k in enumerate(axes))
    places = ", ".join(f"(i{k} - 1) * h AS {k}" for k in axes)
    nodes = f"SELECT *, {places} FROM (SELECT p_partkey + 1 AS i, p_size, p_retailprice, m, 1.0::DOUBLE / (m + 2) AS h, {coords} FROM part, g WHERE p_partkey < {power(dim)})"
    parts = [f"SELECT i, i AS j, 2 * {dim} * {a} / (h * h) + {c} + p_size AS v, true AS inside, 0.0 AS g FROM n"]
    for n, k in enumerate(axes):
        for sign, edge, face in ((-1, "1", 0.0), (1, "m", 1.0)):
            at = repr(face) if k == "x" else "x"
            parts.append(f"SELECT i, i + {sign} * ({power(dim - 1 - n)}) AS j, -{a} / (h * h) {'-' if sign < 0 else '+'} {b[n]} / (2 * h) AS v, i{k} <> {edge} AS inside, CASE WHEN {at} = 0 OR {at} = 1 THEN 1.0 ELSE 0.0 END AS g FROM n")
    base = with_(size, cte("n", nodes), cte("e", " UNION ALL ".join(parts)))
    return base + "SELECT i, j, round(v, 6) AS v FROM e WHERE inside", base + "SELECT e.i, round(any_value(n.p_retailprice) + sum(CASE WHEN inside THEN 0 ELSE -v * g END), 6) AS v FROM e JOIN n ON n.i = e.i GROUP BY e.i"


def shelf(skew: float = 0.0) -> list[str]:
    """CTEs ``a`` (i, j, v), ``b`` (i, v) and ``p`` (blk, i) of the parts on shelves of ten and blocks of five shelves."""
    ends = "SELECT x.i, x.i + o.k AS j, x.c FROM pn x, (VALUES (-10), (-1), (1), (10)) o(k) WHERE NOT (o.k = 1 AND x.i % 10 = 0) AND NOT (o.k = -1 AND x.i % 10 = 1)"
    return [
        cte("pn", "SELECT p_partkey + 1 AS i, p_size AS size, p_retailprice AS price, 1 + coalesce(q, 0) / 100.0::DOUBLE AS c FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"),
        cte("pw", f"SELECT e.i, e.j, (e.c + y.c) / 2 AS w FROM ({ends}) e JOIN pn y ON y.i = e.j"),
        cte("a", f"SELECT i, j, -w * CASE WHEN j > i THEN {1.0 + skew!r} ELSE {1.0 - skew!r} END::DOUBLE AS v FROM pw UNION ALL SELECT pn.i, pn.i, 1.5 * coalesce(s, 0) + size / 10.0::DOUBLE FROM pn LEFT JOIN (SELECT i, sum(w) AS s FROM pw GROUP BY i) t ON t.i = pn.i"),
        cte("b", "SELECT i, price AS v FROM pn"),
        cte("p", "SELECT i, (i - 1) // 50 AS blk FROM pn"),
    ]
