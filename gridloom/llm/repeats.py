"""Removal of repeated 200-byte strings from whole texts by prefix-free parsing.

*Parsing.*  A rolling hash of ``W`` bytes is taken at each position; the positions that hold the least hash of some
200-byte window are triggers and cut a text into phrases.  Equal windows hold the same trigger at the same place, so
each window belongs to one trigger, and a phrase is never longer than a window (taking window minima rather than
hash values divisible by a constant guarantees this also for texts without such values).

*Dictionary.*  Phrases with their context (the bytes that all windows of a trigger can reach) are sorted by trigger
and context; equal neighbours in that order are phrases whose windows all repeat.  Only where a trigger has several
different contexts, at the edges of repeats, are the windows themselves put in order, by (trigger, offset, window).
The parse is never expanded: highly repetitive text costs one entry for each phrase, not for each byte.

The order is kept by hash ranges of the triggers rather than in one array, so that each range is a task of bounded
size; order between triggers is never needed.  Compared strings are represented by 64-bit hashes.

Edge cases: null text is empty; a text under 200 bytes keeps all; null doc_id rows take part and stay rows; repeated
rows are separate texts (each repeats the other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BYTE_CODES, cut, gather, mix, n_ranges, powers, prefix_hash, scatter, small, span_hash

W, LENGTH = 16, 200
REC = np.dtype([("trig", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("lo", "u1"), ("hi", "u1")])
RUN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("len", "<u4")])
WANT = np.dtype([("doc", "<i8"), ("trig", "<u8"), ("start", "<u4"), ("lo", "u1"), ("hi", "u1"), ("twice", "u1")])


def triggers(data: bytes, length: int = LENGTH):
    """For each run of windows with one trigger: trigger position, first window start, last one, trigger hash, H."""
    n = len(data)
    if n < length:
        return None
    h = prefix_hash(data)
    at = np.arange(n - W + 1)
    g = span_hash(h, at, at + W)
    # The least hash in each window; among equals the first: minimum by doubling over (hash, position).
    span = length - W + 1
    key = (g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64) if n < 1 << 32 else g
    width, best = 1, key
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(key) - span + 1], best[span - width : span - width + len(key) - span + 1])
    pos = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(pos)) + 1])
    last = np.append(first[1:], len(pos)) - 1
    return pos[first], first, last, g[pos[first]], h


def _context(pos: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the windows of a trigger can reach."""
    return np.maximum(pos + W - length, 0), np.minimum(pos + length, n)


def _parse(ranges: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.zeros(0, REC)]
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                if (t := triggers(data, length)) is None:
                    continue
                pos, first, last, g, h = t
                a, e = _context(pos, len(data), length)
                r = np.empty(len(pos), REC)
                r["trig"], r["doc"], r["start"], r["lo"], r["hi"] = g, row, first, pos - last, pos - first
                r["ctx"] = span_hash(h, a, e) ^ mix((pos - a).astype(np.uint64) * np.uint64(512) + (e - pos).astype(np.uint64))
                made.append(r)
            x = np.concatenate(made)
            parts, (blocks,) = scatter(mix(x["trig"]), ranges, x)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return run


def _slot(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) + np.uint64(77))


def _dictionary(ranges: int, length: int):
    """Sorts phrases by trigger and context: runs whose windows all repeat, and edge phrases to look into."""

    def run(t: pa.Table) -> pa.Table:
        x = gather(t.column("block"), REC)
        x = x[np.lexsort((x["start"], x["doc"], x["ctx"], x["trig"]))]
        new_trig = np.ones(len(x), bool)
        new_trig[1:] = x["trig"][1:] != x["trig"][:-1]
        new_ctx = new_trig.copy()
        new_ctx[1:] |= x["ctx"][1:] != x["ctx"][:-1]
        ctx_id, trig_id = np.cumsum(new_ctx) - 1, np.cumsum(new_trig) - 1
        copies = np.bincount(ctx_id)[ctx_id]
        contexts = np.bincount(trig_id, weights=new_ctx)[trig_id]
        full, edge = copies >= 2, (contexts >= 2) & new_ctx
        f = x[full]
        runs = np.empty(len(f), RUN)
        # A run of windows [start, start + hi - lo] covers that many bytes and one window more.
        runs["doc"], runs["start"], runs["len"] = f["doc"], f["start"], f["hi"].astype(np.uint32) - f["lo"] + length
        p1, (b1,) = scatter(_slot(runs["doc"]), ranges, runs)
        e = x[edge]
        want = np.empty(len(e), WANT)
        for c in ("doc", "trig", "start", "lo", "hi"):
            want[c] = e[c]
        want["twice"] = copies[edge] >= 2
        p2, (b2,) = scatter(_slot(want["doc"]), ranges, want)
        out_part, out_full, out_edge = p1 + p2, b1 + [None] * len(p2), [None] * len(p1) + b2
        docs = np.unique(e["doc"])
        return pa.table({"part": pa.array(out_part + [None] * len(docs), pa.int32()), "runs": pa.array(out_full + [None] * len(docs), pa.binary()), "edges": pa.array(out_edge + [None] * len(docs), pa.binary()), "doc": pa.array([None] * len(out_part) + docs.tolist(), pa.int64())})

    return run


def _contexts(ranges: int, length: int):
    """The bytes around edge phrases, dealt by trigger."""

    def run(texts: pa.Table, edges: pa.Table) -> pa.Table:
        want = gather(edges.column("edges"), WANT)
        want = want[np.argsort(want["doc"], kind="stable")]
        recs, blobs = [], []
        for row, text in zip(texts.column("row").to_pylist(), texts.column("text").to_pylist()):
            a, b = np.searchsorted(want["doc"], [row, row + 1])
            data = text.encode("utf-8", "surrogatepass") if text and b > a else b""
            for w in want[a:b]:
                first, last = int(w["start"]), int(w["start"]) + int(w["hi"]) - int(w["lo"])
                recs.append(w)
                blobs.append(data[first : last + length].ljust(2 * length, b"\0"))
        r = np.array(recs, WANT) if recs else np.zeros(0, WANT)
        text = np.frombuffer(b"".join(blobs), f"V{2 * length}") if blobs else np.zeros(0, f"V{2 * length}")
        parts, (b1, b2) = scatter(mix(r["trig"]), ranges, r, text)
        return pa.table({"part": pa.array(parts, pa.int32()), "edges": pa.array(b1, pa.binary()), "bytes": pa.array(b2, pa.binary())})

    return run


def window_hashes(raw: np.ndarray, span: int, length: int) -> np.ndarray:
    """Hashes of the first ``span`` windows of each row of bytes."""
    h = np.zeros((raw.shape[0], raw.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_CODES[raw] * powers(raw.shape[1])[0], axis=1, out=h[:, 1:])
    at = np.arange(span)
    return mix((h[:, at + length] - h[:, at]) * powers(raw.shape[1])[1][at])


def _windows(ranges: int, length: int):
    """Puts the windows of edge phrases in order by (trigger, offset, window); equal neighbours repeat."""

    def run(t: pa.Table) -> pa.Table:
        r = gather(t.column("edges"), WANT)
        raw = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(r), 2 * length)
        o = np.argsort(r["trig"], kind="stable")
        r, raw = r[o], raw[o]
        cover = []
        span = int((r["hi"].astype(int) - r["lo"]).max(initial=0)) + 1
        repeated = np.zeros((len(r), span), bool)
        hashes = np.zeros((len(r), span), np.uint64)
        for a in range(0, len(r), 4096):  # hashed in blocks of bounded size
            hashes[a : a + 4096] = window_hashes(raw[a : a + 4096], span, length)
        hi, lo = r["hi"].astype(int), r["lo"].astype(int)
        for offset in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
            who = np.flatnonzero((lo <= offset) & (offset <= hi))
            col = hi[who] - offset
            k = mix(r["trig"][who] + np.uint64(offset)) ^ hashes[who, col]
            order = np.argsort(k, kind="stable")
            same = k[order][1:] == k[order][:-1]
            hit = r["twice"][who][order].astype(bool)
            both = np.zeros(len(who), bool)
            both[1:] |= same
            both[:-1] |= same
            repeated[who[order], col[order]] = both | hit
        for i in range(len(r)):
            if r["twice"][i]:
                continue  # its run is known to repeat
            d = np.diff(np.concatenate([[0], repeated[i].view(np.int8), [0]]))
            for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)):
                cover.append((r["doc"][i], r["start"][i] + s, e - s - 1 + length))
        runs = np.array(cover, RUN) if cover else np.zeros(0, RUN)
        parts, (blocks,) = scatter(_slot(runs["doc"]), ranges, runs)
        return pa.table({"part": pa.array(parts, pa.int32()), "runs": pa.array(blocks, pa.binary())})

    return run


def _cleaned(with_bytes: bool):
    def run(texts: pa.Table, runs: pa.Table) -> pa.Table:
        r = gather(runs.column("runs"), RUN)
        r = r[np.argsort(r["doc"], kind="stable")]
        rows = []
        for row, doc, text in zip(texts.column("row").to_pylist(), texts.column("doc_id").to_pylist(), texts.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            a, b = np.searchsorted(r["doc"], [row, row + 1])
            gone, spans, kept = 0, 0, data
            if b > a:
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, r["start"][a:b].astype(np.int64), 1)
                np.add.at(edge, r["start"][a:b].astype(np.int64) + r["len"][a:b], -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
            rows.append((doc, len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        cols = list(zip(*rows)) or [()] * 6
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds)})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, total_bytes: int | None = None, with_bytes: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) without repeated strings of ``length`` bytes (32 to 250).

    Returns rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and with ``with_bytes`` the bytes kept.
    """
    if not 2 * W <= length <= 250:
        raise ValueError("length must be from 32 to 250 bytes")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A row is named by the hash of its id and text and by its number among equal ones, without a global order.
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    again = named.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    if again.limit(1).count():
        from pyspark.sql import Window

        w = Window.partitionBy("key").orderBy("doc_id")
        some = named.join(again.select("key"), "key", "left_semi").withColumn("row", F.xxhash64("key", F.row_number().over(w))).select("doc_id", "text", "row")
        named = cut(named.join(again.select("key"), "key", "left_anti").select("doc_id", "text", F.col("key").alias("row")).union(some))
    else:
        named = named.select("doc_id", "text", F.col("key").alias("row"))
    size = total_bytes or docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = n_ranges(spark, size, 16 << 20)
    parsed = named.select("row", "text").mapInArrow(_parse(ranges, length), "part int, block binary")
    found = cut(parsed.groupBy("part").applyInArrow(_dictionary(ranges, length), "part int, runs binary, edges binary, doc long"))
    dealt = named.mapInArrow(_deal(ranges), "part int, doc_id long, text string, row long")
    edged = small(cut(found.where("doc is not null").select(F.col("doc").alias("row")).distinct()), 500_000)
    looked = named.join(edged, "row", "left_semi").select("doc_id", "text", "row").mapInArrow(_deal(ranges), "part int, doc_id long, text string, row long")
    ctx = looked.groupBy("part").cogroup(found.where("edges is not null").select("part", "edges").groupBy("part")).applyInArrow(_contexts(ranges, length), "part int, edges binary, bytes binary")
    more = cut(ctx.groupBy("part").applyInArrow(_windows(ranges, length), "part int, runs binary"))
    runs = found.where("runs is not null").select("part", "runs").union(more)
    out = dealt.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_cleaned(with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


def _deal(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row").to_numpy()
            part = ((_slot(row) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column("doc_id"), b.column("text"), b.column("row")], names=["part", "doc_id", "text", "row"])

    return run
