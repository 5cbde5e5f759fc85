"""A configured run from a parameter file, from the generated problem to the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import blas
from gridloom.plans.preconditioner import Preconditioner, solve
from gridloom.sources.files import parameter, read_parameters
from gridloom.sources.generators import poisson

#: The first lines of a file, one value each; further lines are options: KEY value [PRE or POST].
FIELDS = (("method", str), ("dim", int), ("kind", str), ("idim", int), ("istop", int), ("itmax", int), ("irst", int), ("eps", float), ("preconditioner", str), ("blocks", int))


#: The order of the values in the parameter files of the sample programs, general ones in lower case, options
#: of the preconditioner by their keys.
_HEAD = ("method", "istop", "itmax", "itrace", "irst", "eps", "name", "preconditioner")
_LONG = ("SMOOTHER_TYPE", "SMOOTHER_SWEEPS", "SUB_OVR", "SUB_RESTR", "SUB_PROL", "SUB_SOLVE", "SOLVER_SWEEPS", "AINV_ALG", "SUB_FILLIN", "INV_FILLIN", "SUB_ILUTHRS")
_SHORT = ("SMOOTHER_TYPE", "SMOOTHER_SWEEPS", "SUB_OVR", "SUB_RESTR", "SUB_PROL", "SUB_SOLVE", "SUB_FILLIN", "SUB_ILUTHRS")
_COARSE = ("COARSE_SOLVE", "COARSE_SUBSOLVE", "COARSE_MAT", "COARSE_FILLIN", "COARSE_ILUTHRS", "COARSE_SWEEPS")
GENERATED = (
    ("storage", "idim", "kind", *_HEAD), _LONG,
    ("ML_CYCLE", "OUTER_SWEEPS", "MAX_LEVS", "MIN_COARSE_SIZE_PER_PROCESS", "AGGR_PROL", "PAR_AGGR_ALG", "AGGR_TYPE", "AGGR_SIZE", "AGGR_ORD", "MIN_CR_RATIO", "AGGR_FILTER", "AGGR_THRESH", "n_thresholds", "thresholds"), _COARSE,
)
FROM_FILE = (
    ("matrix", "rhs", "guess", "solution", "format", "storage", "part", *_HEAD), _SHORT,
    ("ML_CYCLE", "OUTER_SWEEPS", "MAX_LEVS", "MIN_COARSE_SIZE", "AGGR_PROL", "PAR_AGGR_ALG", "AGGR_ORD", "MIN_CR_RATIO", "AGGR_FILTER", "AGGR_THRESH", "n_thresholds", "thresholds"), _COARSE,
)


def read_layout(text: str, layout=GENERATED) -> tuple[dict[str, str], Preconditioner]:
    """The general values of a sample program's parameter file and the preconditioner that it describes.

    A negative number keeps the default; the second smoother is left out where it is NONE; thresholds count by level.
    What follows the coarse solver (dump switches) is given back under the key ``rest``.
    """
    head, smoother, multilevel, coarse = layout
    values = read_parameters(text)
    names = [*head, *smoother, *(f"{k} POST" for k in smoother), *multilevel, *coarse]
    if len(values) < len(names):
        raise ValueError(f"a parameter file of this layout has {len(names)} values, not {len(values)}")
    given = dict(zip(names, values))
    general = {k: given[k] for k in head} | {"rest": values[len(names) :]}
    pre = Preconditioner(given["preconditioner"].upper())
    second = given["SMOOTHER_TYPE POST"].upper() != "NONE"
    for name in names[len(head) :]:
        key, *pos = name.split()
        if key.islower() or (pos and not second):
            continue
        value = _value(given[name])
        if isinstance(value, (int, float)) and value < 0:
            continue
        pre.set(key, value, pos=pos[0] if pos else "PRE" if second and key in smoother else None)
    for lev, x in enumerate(given["thresholds"].split()[: max(int(given["n_thresholds"]), 0)], 1):
        pre.set("AGGR_THRESH", parameter(x, float), ilev=lev)
    return general, pre


def run_layout(spark: SparkSession, text: str, dim: int = 3, blocks: int | None = None, system: tuple[DataFrame, DataFrame] | None = None, layout=GENERATED) -> Report:
    """Builds and solves what a sample program's parameter file describes; ``system`` gives (A, b) where it is not generated."""
    general, pre = read_layout(text, layout)
    a, b = system or poisson(spark, dim, int(general["idim"]), general["kind"].lower())
    a, b = blas.cut(a), blas.cut(b)
    return _solved(a, b, pre.build(a, n_blocks=blocks), general["method"], parameter(general["eps"], float), int(general["itmax"]), int(general["istop"]), int(general["irst"]))


@dataclass
class Report:
    x: DataFrame
    iterations: int
    error: float
    converged: bool
    levels: int
    residual_2: float
    residual_max: float


def _value(text: str):
    """A number or truth value where the text reads as one."""
    for cast in (int, float):
        try:
            return parameter(text, cast)
        except ValueError:
            continue
    return parameter(text, bool) if text.strip(".").upper() in ("T", "F", "TRUE", "FALSE") else text


def _solved(a, b, pre, method, eps, itmax, istop, irst) -> Report:
    got = solve(a, b, pre, method, eps=eps, itmax=itmax, istop=istop, irst=irst)
    r = blas.cut(blas.residual(a, got.x, b))
    return Report(got.x, got.iterations, got.error, got.converged, pre.n_levels(), blas.nrm2(r), blas.amax(r))


def configure(lines: list[str], kind: str) -> Preconditioner:
    """A preconditioner with the options of ``lines``; values become numbers or truth values where they read as such."""
    pre = Preconditioner(kind)
    for line in lines:
        key, value, *pos = line.split()
        value = _value(value)
        pre.set(key, value, pos=pos[0] if pos else None)
    return pre


def run(spark: SparkSession, text: str, systems: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> Report:
    """Builds and solves what the text of a parameter file describes.

    ``systems`` may hold given systems (A, b) by name; a file names one in the place of its coefficients.
    """
    values = read_parameters(text)
    p = {name: parameter(v, kind) for (name, kind), v in zip(FIELDS, values)}
    if len(p) < len(FIELDS):
        raise ValueError(f"a parameter file needs {len(FIELDS)} values before its options")
    name = p["kind"].lower()
    a, b = systems[name] if systems and name in systems else poisson(spark, p["dim"], p["idim"], name)
    a, b = blas.cut(a), blas.cut(b)
    pre = configure(values[len(FIELDS) :], p["preconditioner"]).build(a, n_blocks=p["blocks"])
    return _solved(a, b, pre, p["method"], p["eps"], p["itmax"], p["istop"], p["irst"])
