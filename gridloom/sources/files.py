"""Matrix Market and Harwell-Boeing readers, parameter files and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """Data lines with their number in the file, the banner, and the number of the size line."""
    raw = spark.read.text(path).select(F.col("value").alias("line"))
    raw = raw.withColumn("seq", F.monotonically_increasing_id())
    banner = raw.where("seq = 0").first()["line"]
    size = raw.where(~F.col("line").startswith("%") & (F.trim("line") != "")).orderBy("seq").limit(1).first()
    return raw.where((F.col("seq") > size["seq"]) & (F.trim("line") != "") & ~F.col("line").startswith("%")), banner, size["line"]


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Matrix Market coordinate file to (i, j, v), 1-based; symmetric storage is mirrored, duplicates are summed.

    Complex files give v as struct<re, im>; hermitian storage is mirrored with the conjugate.  A folder that
    ``write_matrix_market`` has written is read by its header and entries.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/0-header")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        data, banner = spark.read.text(f"{path}/1-entries").select(F.col("value").alias("line")), _lines(spark, f"{path}/0-header")[1]
    else:
        data, banner, _ = _lines(spark, path)
    kind = banner.lower().split()
    t = F.split(F.trim("line"), r"\s+")
    if "complex" in kind:
        v = F.struct(F.get(t, 2).cast("double").alias("re"), F.get(t, 3).cast("double").alias("im"))
        m = data.select(F.get(t, 0).cast("long").alias("i"), F.get(t, 1).cast("long").alias("j"), v.alias("v"))
        if not {"symmetric", "skew-symmetric", "hermitian"}.isdisjoint(kind):
            re, im = (-1.0, -1.0) if "skew-symmetric" in kind else (1.0, -1.0 if "hermitian" in kind else 1.0)
            m = m.union(m.where("i <> j").select("j", "i", F.struct((F.col("v.re") * re).alias("re"), (F.col("v.im") * im).alias("im")).alias("v")))
        return m.groupBy("i", "j").agg(F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im")).alias("v"))
    v = F.lit(1.0) if "pattern" in kind else F.get(t, 2).cast("double")
    m = data.select(F.get(t, 0).cast("long").alias("i"), F.get(t, 1).cast("long").alias("j"), v.alias("v"))
    if "symmetric" in kind or "skew-symmetric" in kind:
        sign = -1.0 if "skew-symmetric" in kind else 1.0
        m = m.union(m.where("i <> j").select("j", "i", (F.col("v") * sign).alias("v")))
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def read_array(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Matrix Market dense array of one column to (i, v); the name NONE or None means absent.

    Positions come from counts by partition, so only the counts (one for each partition) reach the driver.
    """
    if path is None or path.upper() == "NONE":
        return None
    data, _, _ = _lines(spark, path)
    data = data.withColumn("part", F.expr("seq >> 33"))
    counts = sorted((r[0], r[1]) for r in data.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(starts, "part long, base long"))
    pos = F.row_number().over(Window.partitionBy("part").orderBy("seq"))
    return data.withColumn("p", pos).join(base, "part").select((F.col("base") + F.col("p")).alias("i"), F.trim("line").cast("double").alias("v"))


def parse_harwell_boeing(text: str) -> dict:
    """Matrix entries and optional right-hand side, guess and solution from the text of one file (fixed columns); complex
    files give complex numbers."""
    lines = text.splitlines()
    counts = [int(lines[1][14 * k : 14 * k + 14].strip() or 0) for k in range(5)]
    kind = lines[2][:3].upper()
    n_rows, n_cols, nnz = (int(lines[2][14 + 14 * k : 28 + 14 * k]) for k in range(3))
    fmts = [f.strip() for f in (lines[3][:16], lines[3][16:32], lines[3][32:52], lines[3][52:72])]
    at, rhs_kind = 4, ""
    if counts[4]:
        rhs_kind, at = lines[4][:3].upper(), 5

    def take(n_lines: int, fmt: str, cast):
        nonlocal at
        m = re.search(r"(\d+)?[A-Z](\d+)", fmt.upper().split("P")[-1].lstrip(","))
        width = int(m.group(2))
        out = []
        for line in lines[at : at + n_lines]:
            out += [cast(x.replace("D", "E").replace("d", "e")) for k in range(0, len(line.rstrip()), width) if (x := line[k : k + width].strip())]
        at += n_lines
        return out

    def numbers(n_lines: int, fmt: str):
        x = take(n_lines, fmt, float)
        return [complex(re_, im) for re_, im in zip(x[::2], x[1::2])] if kind[0] == "C" else x

    ptr, idx = take(counts[1], fmts[0], int), take(counts[2], fmts[1], int)
    val = numbers(counts[3], fmts[2]) if kind[0] != "P" else [1.0] * nnz
    entries = [(idx[k], col + 1, val[k]) for col in range(n_cols) for k in range(ptr[col] - 1, ptr[col + 1] - 1)]
    if kind[1] in "SHZ":  # symmetric, hermitian (symmetric for real values), skew
        turned = {"S": lambda v: v, "H": lambda v: v.conjugate(), "Z": lambda v: -v}[kind[1]]
        entries += [(j, i, turned(v)) for i, j, v in entries if i != j]
    out = {"entries": entries, "n": n_rows, "rhs": None, "guess": None, "solution": None}
    if counts[4]:
        dense = numbers(counts[4], fmts[3])
        names = ["rhs"] + (["guess"] if "G" in rhs_kind[1:] else []) + (["solution"] if "X" in rhs_kind[1:] else [])
        for k, name in enumerate(names):
            out[name] = dense[k * n_rows : (k + 1) * n_rows]
    return out


#: The largest sequential file that the driver reads.
MAX_FILE_BYTES = 256 << 20


def read_harwell_boeing(spark: SparkSession, path: str) -> dict:
    """The parts of a Harwell-Boeing file as DataFrames; the format is one sequential file, whose size is checked.

    Values of a complex file are struct<re, im>.
    """
    size = spark.read.text(path).agg(F.sum(F.length("value") + 1)).first()[0] or 0
    if size > MAX_FILE_BYTES:
        raise ValueError(f"a Harwell-Boeing file of {size} bytes is too large for the driver")
    p = parse_harwell_boeing(spark.read.text(path, wholetext=True).first()[0])
    is_complex = any(isinstance(e[2], complex) for e in p["entries"][:1])
    kind, plain = ("struct<re:double,im:double>", lambda v: (v.real, v.imag)) if is_complex else ("double", lambda v: v)
    vec = lambda x: None if x is None else spark.createDataFrame([(k, plain(v)) for k, v in enumerate(x, 1)], f"i long, v {kind}")
    matrix = spark.createDataFrame([(i, j, plain(v)) for i, j, v in p["entries"]], f"i long, j long, v {kind}")
    return {"matrix": matrix, "rhs": vec(p["rhs"]), "guess": vec(p["guess"]), "solution": vec(p["solution"])}


def read_parameters(text: str) -> list[str]:
    """Values of a parameter file, one a line: lines that start with % are skipped, text after ! is dropped."""
    return [v for line in text.splitlines() if not line.startswith("%") and (v := line.split("!")[0].strip())]


def parameter(value: str, kind: type):
    if kind is bool:
        return value.strip().upper().strip(".") in ("T", "TRUE", "Y", "YES", "1")
    return kind(value.replace("D", "E").replace("d", "e")) if kind is float else kind(value)


def write_matrix(df: DataFrame, path: str) -> None:
    """A sink for any matrix, vector or factor: Parquet, distributed."""
    df.write.mode("overwrite").parquet(path)


def write_matrix_market(df: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Coordinate text with a header part; entries are written by all tasks, ordered by row range."""
    spark = df.sparkSession
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{n_rows} {n_cols} {df.count()}",)], "value string").coalesce(1)
    body = df.orderBy("i", "j").select(F.concat_ws(" ", "i", "j", F.col("v").cast("string")).alias("value"))
    head.write.mode("overwrite").text(f"{path}/0-header")
    body.write.mode("overwrite").text(f"{path}/1-entries")


def write_solution(x: DataFrame, r: DataFrame, b: DataFrame, path: str) -> None:
    """I, X(I), R(I), B(I) of a solve."""
    out = b.select("i", F.col("v").alias("b")).join(x.select("i", F.col("v").alias("x")), "i", "left").join(r.select("i", F.col("v").alias("r")), "i", "left")
    out.select("i", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), "b").orderBy("i").write.mode("overwrite").csv(path, header=True)
