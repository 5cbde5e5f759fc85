"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of the test items.

Texts are lower-cased (A-Z) and split to words (ASCII letters and digits and everything beyond ASCII).  A window is
ten consecutive words of an item; an item of fewer, but not none, is one window.  The automaton runs over word numbers,
so a window is ten symbols.  A text is scanned once: stretches of words in which every pair of neighbours stands in some
item go through the automaton, no window can reach beyond one.  Hits are mapped back to offsets in the original text.

The automaton is built once in each worker from a broadcast of the items.  It has at most ten nodes for each word of them
(about 60 bytes each), so a benchmark of more than ``MAX_WORDS`` words is dealt to several automata of at most about that
size, one at a time in the driver and in the workers, and the texts are scanned once for each; an item of more words than
``ITEM_WORDS`` is cut to pieces that share nine words.

Edge cases: null or wordless documents have no words and no hits; null item texts have no windows; items with a null
id hit words but are not listed; repeated items count once; texts and items of any length are scanned whole; empty tables give no hits or no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, keyed

WIDTH, MAX_WORDS, ITEM_WORDS = 10, 400_000, 50_000
#: Bytes of words: digits, letters (lower-cased) and all bytes of characters beyond ASCII; others become spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Windows:
    """The windows of some items: word numbers, known pairs of neighbours, and the automaton over word numbers."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.single: dict[int, tuple[int, ...]] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        pairs = [np.zeros(0, np.int64)]
        for item, text in items:
            x = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(x) - WIDTH + 1) if x else 0):
                owners.setdefault(tuple(x[i : i + WIDTH]), set()).update([] if item is None else [item])
            y = np.array(x, np.int64)
            pairs.append(y[:-1] << 32 | y[1:])
        self.pairs = np.unique(np.concatenate(pairs))
        self.least = min((len(w) for w in owners if len(w) > 1), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in owners.items():
            if len(w) == 1:
                self.single[w[0]] = tuple(ids)
            else:
                self.automaton.add_word(w, (len(w), tuple(ids)))
        if self.least:
            self.automaton.make_automaton()
        self.alone = np.array(sorted(self.single), np.int64)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, words, owners) of every occurrence of a window."""
        get = self.number.get
        x = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for i in np.flatnonzero(_among(x, self.alone)).tolist():
            yield i, 1, self.single[int(x[i])]
        if self.least and len(x) >= self.least:
            known = np.concatenate([[False], _among(x[:-1] << 32 | x[1:], self.pairs), [False]])
            edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
            for a, b in edges[edges[:, 1] - edges[:, 0] + 1 >= self.least].tolist():
                for end, (n, ids) in self.automaton.iter(tuple(x[a : b + 1].tolist())):
                    yield a + end - n + 1, n, ids


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


_built: dict[str, Windows] = {}


def windows(token: str, items: list[tuple[int | None, str]]) -> Windows:
    """Built once in a worker for items named by ``token``, the hash of their content."""
    if token not in _built:
        _built.clear()
        _built[token] = Windows(items)
    return _built[token]


def content_name(items: list[tuple[int | None, str]]) -> str:
    return hashlib.sha256(repr(sorted(items, key=str)).encode("utf-8", "surrogatepass")).hexdigest()


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            for k in range(0, max(1, len(words) - WIDTH + 1), ITEM_WORDS):
                ids.append(item)
                texts.append(b" ".join(words[k : k + ITEM_WORDS + WIDTH - 1]).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["item_id", "text"])


def digest(items) -> tuple[int, str, list[int]]:
    ids = sorted({*items}, key=str)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Offsets (code points) in the original text of runs of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = np.array([m.span() for m in WORD.finditer(raw.translate(NORMAL))])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    d = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return [(int(chars[at[s][0]]), int(chars[at[e - 1][1]])) for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]


def _result(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans"]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def scan(token: str, items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows(token, items.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                found, hit = set(), None
                for at, n, ids in w.find(words):
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    hit[at : at + n] = True
                    found.update(ids)
                spans = [] if hit is None else [{"start": s, "end": e} for s, e in spans_of(text, hit)]
                rows.append((doc, len(words), 0 if hit is None else int(hit.sum()), *digest(found), spans))
            yield _result(rows)

    return run


def _hits(token: str, items):
    """Rows (row, hits, ids) of texts with windows of one automaton: the first word and the length of each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows(token, items.value)
        for b in batches:
            rows, hits, ids = [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, at = set(), []
                for first, n, owners in w.find(words_of(text)):
                    at.append({"at": first, "n": n})
                    found.update(owners)
                if at:
                    rows.append(row)
                    hits.append(at)
                    ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hits, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), pa.array(ids, pa.list_(pa.int64()))], names=["row", "hits", "ids"])

    return run


def scan_in_parts(docs: DataFrame, benchmark: DataFrame, size: int, max_words: int) -> DataFrame:
    """The same result for a benchmark of ``size`` words, by automata over parts of it."""
    spark = docs.sparkSession
    parts = -(-size // max_words) + 1
    benchmark = benchmark.mapInArrow(_cut_items, "item_id long, text string")
    benchmark = cut(benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")))
    d = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    hits = None
    for p in range(parts):
        items = [(r[0], r[1]) for r in benchmark.where(F.col("part") == p).select("item_id", "text").collect()]  # max_words, about
        sent = spark.sparkContext.broadcast(items)
        one = cut(d.select("row", "text").mapInArrow(_hits(content_name(items), sent), "row long, hits array<struct<at:int,n:int>>, ids array<long>"))
        sent.unpersist()
        hits = one if hits is None else hits.union(one)
    per = hits.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    joined = d.join(per, "row", "left").select("doc_id", "text", "hits", "ids")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, hits, ids in zip(*(c.to_pylist() for c in b.columns)):
                n = len(words_of(text))
                hit = np.zeros(n, bool)
                for h in hits or []:
                    hit[h["at"] : h["at"] + h["n"]] = True
                spans = [{"start": s, "end": e} for s, e in spans_of(text, hit)] if hit.any() else []
                rows.append((doc, n, int(hit.sum()), *digest(ids or []), spans))
            yield _result(rows)

    return joined.mapInArrow(run, SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, items, spans, contaminated), one for each document row.

    ``spans`` are the runs of hit words as code point offsets in the original text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = benchmark.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) + 1)).first()[0] or 0
    if size > max_words:
        out = scan_in_parts(docs, benchmark, size, max_words)
    else:
        items = [(r[0], r[1]) for r in benchmark.collect()]  # at most max_words words
        out = docs.mapInArrow(scan(content_name(items), spark.sparkContext.broadcast(items)), SCHEMA)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark, those without a doc_id included; others stay as they are."""
    rows, key = keyed(docs)
    found = find_contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark)
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return rows.join(bad, key, "left_anti").select(*docs.columns)
