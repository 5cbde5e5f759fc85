"""Byte-level BPE by prefix dynamic programming, with the ranks of a given vocabulary.

Method: the encoding of every prefix of a piece is unique, so it has one last token, and the encoding of a prefix is that
of the prefix before its last token and this token.  A token may follow another exactly where merging their joined bytes
leaves both whole.  So for each place the tokens that end there (from an Aho-Corasick automaton over the vocabulary) are
tried, the longest first, and the one that may follow the last token of the prefix before it is stored.  Work is linear
in the bytes; a byte that comes later changes nothing stored, so texts are appended to exactly, and an edit is
encoded anew only up to where the pieces fall into step again.

Whether two tokens may stand side by side: their merges go by rank; a merge across the border happens when its rank is
below that of the next merge of the left token's right edge, and not above that of the right token's left edge (the
leftmost of equal ranks goes first).  Edges come from the merges of each token alone, made once on the driver.  Tokens that
merging does not yield (or only out of order of ranks) stand for whole pieces only, as in the common library; if a byte has
no token, it is an error.

The vocabulary travels as one object (its size is checked); each Python worker keeps encodings of up to twice
``CACHE`` pieces.

Edge cases: a null or empty text has no ids; a piece of any length is encoded in linear work; a repeated row gives a row
each time; an empty table gives an empty result; only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces whose encodings a worker keeps, twice, and the longest such piece.
CACHE, CACHED_CHARS = 150_000, 40
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 300_000
MAX_VOCABULARY_BYTES = 64 << 20
NEVER = 1 << 62


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Parts of ``piece`` after all merges, lowest rank first, and the (rank, place) of each merge; quadratic: for tokens."""
    parts, done = [piece[k : k + 1] for k in range(len(piece))], []
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        done.append((rank, k))
    return parts, done


@dataclass
class Vocabulary:
    """Tokens by id, the pattern of pieces, and the edges of each token.

    ``right[t]`` has the ids of the parts along the right edge of token t, from its last byte to itself, so that each part
    is merged on at the rank of the next; ``left[t]`` likewise from the first byte.  A token without edges is no result of
    merges.
    """

    tokens: dict[int, bytes]
    pattern: str
    right: dict[int, tuple[int, ...]]
    left: dict[int, tuple[int, ...]]
    name: str


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """Reads a file of lines ``base64 rank`` (at most ``MAX_VOCABULARY_BYTES``, checked) and works out the edges.

    A path without a scheme is a file of the driver, any other one is read by Spark.
    """
    if "://" in path:
        size = spark.read.text(path).select(F.sum(F.length("value") + 1)).first()[0] or 0
    else:
        size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large")
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().split("\n")
    return edges_of({base64.b64decode(a): int(n) for a, n in (line.split() for line in lines if line.strip())}, pattern)


def edges_of(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    missing = [k for k in range(256) if bytes([k]) not in ranks]
    if missing:
        raise ValueError(f"no token for the bytes {missing}")
    right, left = {}, {}
    for token, number in ranks.items():
        parts, done = merged(token, ranks)
        if len(parts) > 1 or any(a[0] > b[0] for a, b in zip(done, done[1:])):
            continue
        # Played once more: which merges touch the last or the first part.
        parts, r, f = [token[k : k + 1] for k in range(len(token))], [ranks[token[-1:]]], [ranks[token[:1]]]
        for rank, k in done:
            if k == len(parts) - 2:
                r.append(rank)
            if k == 0:
                f.append(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        right[number], left[number] = tuple(r), tuple(f)
    name = hashlib.sha256(pattern.encode() + b"".join(t + b"%d," % n for t, n in sorted(ranks.items()))).hexdigest()
    return Vocabulary({n: t for t, n in ranks.items()}, pattern, right, left, name)


class Encoder:
    """Encodes pieces and texts with a vocabulary; kept for each worker."""

    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex

        self.v, self.ranks = v, {t: n for n, t in v.tokens.items()}
        self.split = regex.compile(v.pattern).findall
        self.automaton = ahocorasick.Automaton()
        for n in v.right:  # a byte as the character of the same number
            self.automaton.add_word(v.tokens[n].decode("latin-1"), n)
        self.automaton.make_automaton()
        self.size = {n: len(t) for n, t in v.tokens.items()}
        self.longest = max(self.size.values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.coded = {n: n.to_bytes(4, "little") for n in v.tokens}
        self.pairs: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b leaves both whole."""
        ends, starts, i, j = self.v.right[a], self.v.left[b], 0, 0
        tokens, rank = self.v.tokens, self.ranks.get
        while True:
            up = ends[i + 1] if i + 1 < len(ends) else NEVER
            down = starts[j + 1] if j + 1 < len(starts) else NEVER
            across = rank(tokens[ends[i]] + tokens[starts[j]], NEVER)
            if across < up and across <= down and across != NEVER:
                return False
            if up == NEVER and down == NEVER:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def last_tokens(self, piece: bytes, stored: list[int] | None = None) -> list[int]:
        """For each prefix of ``piece`` (from length 0, which has none: -1) its last token; ``stored`` are those of a shorter one."""
        last = [-1] if stored is None else list(stored)
        size, pairs, follow = self.size, self.pairs, self.may_follow
        # Tokens that end later may begin up to the longest token before what is new.
        start = max(0, len(last) - 1 - self.longest)
        settled = len(last) - 1
        # The automaton gives the tokens that end at a place one after the other, the longest first.
        for end, token in self.automaton.iter(piece[start:].decode("latin-1")):
            end += start
            if end < settled:
                continue
            before = end + 1 - size[token]
            if before:
                pair = last[before] << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = follow(last[before], token)
                if not ok:
                    continue
            last.append(token)
            settled = end + 1
        return last

    def tokens_of(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        got = self.known.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                data = text.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(data)
                got = self.coded[whole] if whole is not None else b"".join([self.coded[t] for t in self.tokens_of(self.last_tokens(data))])
            if len(text) <= CACHED_CHARS:
                if len(self.known) >= CACHE:
                    self.older, self.known = self.known, {}
                self.known[text] = got
        return got

    def encode(self, text: str) -> bytes:
        piece, known = self.piece, self.known.get
        return b"".join([known(p) or piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoded:
    """A text with its pieces and their encodings: appended to and edited without encoding the rest again.

    A piece depends on the text from its start on only, and a match looks at most at the end of the run of white space
    after it; so two pieces before a change are taken again, and nothing after a common start of pieces beyond it.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.starts, self.pieces = encoder, "", [], []
        self.again = 0
        self.edit(0, 0, text)

    def edit(self, start: int, end: int, by: str) -> "Encoded":
        """Replaces the characters [start, end)."""
        text = self.text[:start] + by + self.text[end:]
        first = max(0, bisect_right(self.starts, start) - 3)
        at = self.starts[first] if self.starts else 0
        shift, beyond = len(by) - (end - start), start + len(by)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, pieces = self.starts[:first], self.pieces[:first]
        import regex

        step = regex.compile(self.encoder.v.pattern)
        self.again = 0
        for m in step.finditer(text, at):
            if m.start() >= beyond and m.start() in old:  # in step again
                k = old[m.start()]
                starts += [s + shift for s in self.starts[k:]]
                pieces += self.pieces[k:]
                break
            starts.append(m.start())
            pieces.append(self.encoder.piece(m[0]))
            self.again += 1
        self.text, self.starts, self.pieces = text, starts, pieces
        return self

    def append(self, more: str) -> "Encoded":
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.pieces), "<u4").tolist()


@lru_cache(maxsize=2)
def _encoder(name: str, sent) -> Encoder:
    return Encoder(sent.value)


def _each(sent, name: str, work) -> Iterable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, sent)
        for b in batches:
            yield work(e, b)

    return run


def encode_texts(docs: DataFrame, v: Vocabulary, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the encoding of each text, without special tokens; ids as little-endian unsigned 32-bit integers.

    With ``decoded`` also ``bytes``, what the ids stand for (``decode_ids`` in the same pass).
    """
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def work(e: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [e.encode(t) if t else b"" for t in b.column("text").to_pylist()]
        back = {"bytes": pa.array([e.decode(x) for x in ids], pa.binary())} if decoded else {}
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary()), **back})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_each(sent, v.name, work), "doc_id long, ids binary" + (", bytes binary" if decoded else ""))


def decode_ids(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids, bytes): what the ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(v)

    def work(e: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array([e.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(_each(sent, v.name, work), "doc_id long, ids binary, bytes binary")


def bpe_digest(docs: DataFrame, v: Vocabulary) -> DataFrame:
    out = encode_texts(docs, v, decoded=True)
    return out.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
