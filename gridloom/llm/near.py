"""N-gram Jaccard self-join: size-aware heavy-light join on word shingles.

Two documents link when their sets of distinct five-word shingles have Jaccard similarity of 0.75 or more.  Exact
copies share one node (a hash of the whole set), so groups of copies cost nothing.  A set of size n that links with
another shares at least k elements of its first n - ceil(0.75 n) + k elements in any common order.

* *Small sets* enumerate all subsets of two elements of that prefix (k = 2) and meet on equal subsets.
* *Large sets* (and the small ones just below the boundary, which can link with large ones) are entered in inverted
  lists of the elements of their prefix (k = 1), which are scanned.
* The *boundary* minimises the cost estimated from the histogram of sizes and the mean length of a list.

The common order is by hash, with frequent shingles last.  Frequencies are counted over all shingles of all documents,
by a part of the hash that widens with the input; the most frequent ``HOT`` of them (bounded) are broadcast.  Any order
gives right results.

Lists do not emit all their pairs.  Each list has a *home*: short ones that of their least node, so that the lists two
documents share mostly meet in one task and a pair leaves it once with its count; long ones are spread over several by their length.
Every candidate meets the *parity sketch* of its partner (one bit a shingle; the bits that differ are at most the
elements that differ), which never rejects a link, and those that pass are verified by whole sets.  Star rounds pair each
node with the pivots of its lists and join components.  Then each home looks at all pairs of different components that
were not tried yet: first it hands on ``FORESTS`` spanning forests of them, so that a large group gives as many candidates
as nodes, and after their links have joined components all that are left.  No link that joins two components is lost.

Edge cases: null or empty text or text without words: empty set, linked with nothing; null doc_id: a row of its own
with null component; fewer than five words: the whole sequence is the one shingle; repeated rows stay rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, gather, join_classes, join_one, keyed, mix, n_ranges, scatter, shingle_hashes, small

#: Most frequent shingles that are broadcast (16 bytes each); documents that a shingle must be in to be one of them.
HOT, HOT_DF = 1 << 20, 24
STAR_ROUNDS, PIVOTS, FORESTS = 2, 4, 4
NUM, DEN = 3, 4  # the similarity threshold as a fraction
#: Nodes of a list that still goes to the home of its least node.
SHORT = 64
POSTING = np.dtype([("key", "<u4"), ("key2", "<u2"), ("n", "<u2"), ("sig", "<i8")])
ENTRY = np.dtype([("list", "<u8"), ("sig", "<i8"), ("n", "<u2")])
#: Pairs that are looked at together.
BLOCK = 300_000
PAIR = np.dtype([("x", "<i8"), ("y", "<i8"), ("nx", "<u2"), ("ny", "<u2"), ("k", "<u4")])


def size_code(n: int) -> int:
    """A set size in 16 bits: exact below 1024, ten leading bits above."""
    s = max(int(n).bit_length() - 10, 0)
    return (s << 10) + (n >> s)


def size_low(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return (code & 1023) << (code >> 10)


def size_high(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return (((code & 1023) + 1) << (code >> 10)) - 1


def _sig(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of 64 or more cells (a power of two, twice the size of the set at least)."""
    cells = 64
    while cells < 2 * len(s):
        cells *= 2
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At most the number of elements that only one of two sketched sets has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):  # cells that fall together
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _encoded(x: np.ndarray, kind: type) -> bytes:
    """Sorted values as the first one and gaps of ``kind``; the largest gap stands for a step without an element."""
    top = np.iinfo(kind).max
    gap = np.diff(x)
    skips = (gap // np.uint64(top)).astype(np.int64)
    out = np.full(len(gap) + int(skips.sum()), top, kind)
    out[np.cumsum(skips + 1) - 1] = (gap % np.uint64(top)).astype(kind)
    return x[:1].tobytes() + out.tobytes()


def _decoded(block: bytes, kind: type) -> np.ndarray:
    first, gap = np.frombuffer(block[:8], np.uint64), np.frombuffer(block[8:], kind)
    return np.concatenate([first, first + np.cumsum(gap, dtype=np.uint64)[gap != np.iinfo(kind).max]])


def _profiles(ranges: int, bits: int, kind: type):
    """One pass over the texts: (doc_id, n, sig, sketch) of each, and blocks of shingle hashes for counting."""
    drop = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, sigs, drawn, sets = b.column(0).to_pylist(), [], [], [], [np.zeros(0, np.uint64)]
            for text in b.column(1).to_pylist():
                s = shingle_hashes(text)
                ns.append(len(s))
                sigs.append(_sig(s) if len(s) else None)
                drawn.append(sketch(s) if len(s) else None)
                sets.append(s)
            x = np.sort(np.concatenate(sets))
            part = ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
            x >>= drop
            parts = [int(part[a]) for a in cuts[:-1]]
            blocks = [_encoded(x[a:e], kind) for a, e in zip(cuts[:-1], cuts[1:])]
            k, m = len(parts), len(ids)
            home = (mix(np.array([s or 0 for s in sigs], np.int64).view(np.uint64) + np.arange(m, dtype=np.uint64)) % np.uint64(ranges)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.tolist() + parts, pa.int32()), pa.array(ids + [None] * k, pa.int64()), pa.array(ns + [None] * k, pa.int64()), pa.array(sigs + [None] * k, pa.int64()), pa.array(drawn + [None] * k, pa.binary()), pa.array([None] * m + blocks, pa.binary())],
                names=["part", "doc_id", "n", "sig", "sketch", "block"],
            )

    return run


def _frequent(kind: type):
    """Frequent hashes of a range with their counts, and the profiles unchanged; the other counts only as sums."""

    def run(t: pa.Table) -> pa.Table:
        own = t.filter(t.column("n").is_valid())
        blocks = [_decoded(b, kind) for b in t.column("block").to_pylist() if b is not None]
        x, n = np.unique(np.concatenate([*blocks, np.zeros(0, np.uint64)]), return_counts=True)
        hot = n >= HOT_DF
        rest = n[~hot].astype(float)
        h = pa.array([*x[hot].view(np.int64).tolist(), -1], pa.int64())
        made = {"h": h, "df": pa.array([*n[hot].tolist(), int(rest.sum())], pa.int64()), "df2": pa.array([*[0] * int(hot.sum()), int((rest**2).sum())], pa.int64())}
        return pa.concat_tables([own.select(["doc_id", "n", "sig", "sketch"]), pa.table(made)], promote_options="default")

    return run


def prefix(s: np.ndarray, hot, k: int) -> np.ndarray:
    """The first n - ceil(0.75 n) + k elements in the common order: rare ones by hash, then hot ones by frequency."""
    n = len(s)
    p = min(n, n - -(-NUM * n // DEN) + k)
    if len(hot):
        h = s >> hot[2]
        at = np.searchsorted(hot[0], h)
        found = (at < len(hot[0])) & (hot[0][np.minimum(at, len(hot[0]) - 1)] == h)
        if found.any():
            cold = s[~found]
            if len(cold) < p:
                h, rank = s[found], hot[1][at[found]]
                cold = np.concatenate([cold, h[np.lexsort((h, rank))][: p - len(cold)]])
            return cold[:p]
    return s[:p]


def _postings(ranges: int, hot, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = hot.value
        for b in batches:
            keys, sigs, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for text in b.column(0).to_pylist():
                s = shingle_hashes(text)
                n = len(s)
                if not n:
                    continue
                got = []
                if n < boundary:
                    q = np.sort(prefix(s, spectrum, 2))
                    i, j = np.triu_indices(len(q), 1)
                    got.append(mix(q[i] * np.uint64(3) + q[j]))
                if DEN * n >= NUM * boundary:
                    got.append(prefix(s, spectrum, 1))
                key = np.concatenate(got)
                keys.append(key)
                sigs.append(np.full(len(key), _sig(s), np.int64))
                ns.append(np.full(len(key), size_code(n), np.uint16))
            key = mix(np.concatenate(keys))
            x = np.empty(len(key), POSTING)
            x["key"], x["key2"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(48)).astype(np.uint16)
            x["sig"], x["n"] = np.concatenate(sigs), np.concatenate(ns)
            parts, (blocks,) = scatter(key, ranges, x)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return run


def _shared(ranges: int):
    """Lists of two nodes at least, dealt to their homes."""

    def run(t: pa.Table) -> pa.Table:
        x = gather(t.column("block"), POSTING)
        key = x["key"].astype(np.uint64) | x["key2"].astype(np.uint64) << np.uint64(32)
        o = np.lexsort((x["sig"], key))
        key, x = key[o], x[o]
        first = np.ones(len(x), bool)
        first[1:] = (key[1:] != key[:-1]) | (x["sig"][1:] != x["sig"][:-1])
        key, x = key[first], x[first]
        at, count = _runs(key)
        keep = np.repeat(count >= 2, count)
        # Sorted by node within a list, so the first is the least.
        salt = np.where(count <= SHORT, 0, key[at] % np.maximum(count // 1024, 4).astype(np.uint64))
        home = mix(x["sig"][at].view(np.uint64) + mix(salt.astype(np.uint64)))
        home = np.repeat(home, count)[keep]
        out = np.empty(int(keep.sum()), ENTRY)
        out["list"], out["sig"], out["n"] = key[keep], x["sig"][keep], x["n"][keep]
        out["list"] |= np.uint64(t.column("part")[0].as_py() & 0xFFFF) << np.uint64(48)
        parts, (blocks,) = scatter(home, ranges, out)
        return pa.table({"home": pa.array(parts, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(key)))


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these size codes can link."""
    return (DEN * size_high(a) >= NUM * size_low(b)) & (DEN * size_high(b) >= NUM * size_low(a))


def _counted(x: np.ndarray) -> np.ndarray:
    """One record for each pair of ``x``, with the sum of the counts."""
    x = x[np.lexsort((x["y"], x["x"]))]
    if not len(x):
        return x
    at = np.flatnonzero(np.concatenate([[True], (x["x"][1:] != x["x"][:-1]) | (x["y"][1:] != x["y"][:-1])]))
    out = x[at]
    out["k"] = np.add.reduceat(x["k"], at)
    return out


def _entries(t: pa.Table) -> np.ndarray:
    x = gather(t.column("block"), ENTRY)
    return x[np.argsort(x["list"], kind="stable")]


def _known(x: np.ndarray, nodes: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    """Component (itself where it has none) and number of links of the nodes of ``x``."""
    comp, links = x["sig"].copy(), np.zeros(len(x), np.int64)
    if nodes is not None and nodes.num_rows:
        sig = nodes.column("sig").to_numpy()
        o = np.argsort(sig)
        sig = sig[o]
        at = np.minimum(np.searchsorted(sig, x["sig"]), len(sig) - 1)
        hit = sig[at] == x["sig"]
        comp[hit] = nodes.column("component").to_numpy()[o][at[hit]]
        links[hit] = nodes.column("links").to_numpy()[o][at[hit]]
    return comp, links


def _dealt(pairs: np.ndarray, ranges: int, by: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts, (blocks,) = scatter(by, ranges, pairs)
    return parts, blocks


def _starred(ranges: int, salt: int):
    """Each node with the pivot of each of its lists, counted by pair; the nodes of the home too where ``salt`` is 0.

    The pivot of a list is the node with most links so far, then the least under a salted hash; every node meets the
    pivot only, so the work is linear in the postings.
    """

    def run(t: pa.Table, nodes: pa.Table) -> pa.Table:
        x = _entries(t)
        comp, links = _known(x, nodes)
        rank = mix(x["sig"].view(np.uint64) + np.uint64(salt))
        o = np.lexsort((rank, -links, x["list"]))
        at, count = _runs(x["list"][o])
        pivot = np.repeat(o[at], count)
        ok = (comp[o] != comp[pivot]) & _fits(x["n"][o], x["n"][pivot])
        o, pivot = o[ok], pivot[ok]
        pairs = np.empty(len(o), PAIR)
        pairs["x"], pairs["nx"], pairs["k"] = x["sig"][o], x["n"][o], 1
        pairs["y"], pairs["ny"] = x["sig"][pivot], x["n"][pivot]
        pairs = _counted(pairs)
        parts, blocks = _dealt(pairs, ranges, mix(pairs["x"].view(np.uint64)))
        here = np.unique(x["sig"]).tolist() if salt == 0 else []
        home = t.column("home")[0].as_py()
        k, m = len(parts), len(here)
        return pa.table({"part": pa.array(parts + [home] * m, pa.int32()), "block": pa.array(blocks + [None] * m, pa.binary()), "sig": pa.array([None] * k + here, pa.int64())})

    return run if salt else lambda t: run(t, None)


def _chosen(t: pa.Table) -> pa.Table:
    """For each node the ``PIVOTS`` partners that are pivot of most of its lists."""
    x = _counted(gather(t.column("block"), PAIR))
    low = np.stack([size_low(x["nx"]), size_low(x["ny"])])
    # A link shares need - rest prefix elements; a quarter of them with this pivot makes it worth a look in a star round.
    least = low.sum(axis=0) * NUM / (NUM + DEN) - np.maximum(size_high(x["nx"]), size_high(x["ny"])) * NUM / DEN
    x = x[x["k"] * 4.0 >= least]
    x = x[np.lexsort((x["y"], -x["k"].astype(np.int64), x["x"]))]
    at, count = _runs(x["x"])
    x = x[np.arange(len(x)) - np.repeat(at, count) < PIVOTS]
    return pa.table({"a": np.minimum(x["x"], x["y"]), "b": np.maximum(x["x"], x["y"]), "q": x["y"].copy()})


class Sketches:
    """Sketches of the nodes of a home: for each number of cells a matrix, larger sketches folded into the smaller."""

    def __init__(self, nodes: pa.Table):
        drawn = nodes.column("sketch").to_pylist()
        self.bytes = np.array([len(x) for x in drawn], np.int64)
        self.at, self.bits = {}, {}
        held = np.zeros(0, np.int64)
        rows: np.ndarray | None = None
        for size in sorted(set(self.bytes.tolist()), reverse=True):
            own = np.flatnonzero(self.bytes == size)
            fresh = np.frombuffer(b"".join(drawn[i] for i in own), np.uint64).reshape(len(own), -1)
            if rows is not None:
                while rows.shape[1] > fresh.shape[1]:  # the cells of the upper half fall on those of the lower
                    rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
                fresh, own = np.concatenate([rows, fresh]), np.concatenate([held, own])
            held, rows = own, fresh
            self.at[size] = np.full(len(drawn), -1, np.int64)
            self.at[size][own] = np.arange(len(own))
            self.bits[size] = rows

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most the number of elements that only one set of a pair of nodes (by their rows) has."""
        out, size = np.zeros(len(i), np.int64), np.minimum(self.bytes[i], self.bytes[j])
        for s in np.unique(size):
            here, m = np.flatnonzero(size == s), self.bits[int(s)]
            step = max(1, (32 << 20) // int(s))
            for k in range(0, len(here), step):
                w = here[k : k + step]
                out[w] = np.bitwise_count(m[self.at[int(s)][i[w]]] ^ m[self.at[int(s)][j[w]]]).sum(axis=1)
        return out


def forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges (u, v) are in the spanning forest of least weight; ties go to the earlier edge."""
    n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    edge = np.argsort(rank)
    root, chosen, live = np.arange(n), np.zeros(len(u), bool), np.arange(len(u))
    while len(live):
        best = np.full(n, len(u))
        np.minimum.at(best, root[u[live]], rank[live])
        np.minimum.at(best, root[v[live]], rank[live])
        new = edge[np.unique(best[best < len(u)])]
        chosen[new] = True
        join_classes(root, u[new], v[new])
        live = live[root[u[live]] != root[v[live]]]
    return chosen


def forests(u: np.ndarray, v: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Which edges are in ``k`` spanning forests, each of the edges that the ones before have left."""
    chosen = np.zeros(len(u), bool)
    for _ in range(k):
        rest = np.flatnonzero(~chosen)
        if not len(rest):
            break
        chosen[rest[forest(u[rest], v[rest], weight[rest])]] = True
    return chosen


def _cross(k: int | None):
    """Untried pairs of one list that are of different components, whose sizes fit and whose sketches allow a link.

    With ``k`` only that many spanning forests of the components of the home, the likeliest pairs first.
    """

    def run(t: pa.Table, nodes: pa.Table) -> pa.Table:
        own = nodes.filter(nodes.column("other").is_null()).sort_by("sig")
        sig = own.column("sig").to_numpy()
        x = _entries(t)
        x = x[np.isin(x["sig"], sig)]  # the others are sets without a doc_id
        drawn, at = Sketches(own), np.searchsorted(sig, x["sig"])
        _, klass = np.unique(own.column("component").to_numpy(), return_inverse=True)
        big = np.int64(max(len(sig), 1))
        done = nodes.filter(nodes.column("other").is_valid())
        left, right = done.column("sig").to_numpy(), done.column("other").to_numpy()
        here = np.isin(left, sig) & np.isin(right, sig)
        tried = np.unique(np.searchsorted(sig, left[here]) * big + np.searchsorted(sig, right[here]))
        o = np.lexsort((x["n"], x["list"]))
        x, at = x[o], at[o]
        begin, count = _runs(x["list"])
        # Lists of one component have no pair to give.
        if len(x):
            mixed = np.repeat(np.minimum.reduceat(klass[at], begin) != np.maximum.reduceat(klass[at], begin), count)
            x, at = x[mixed], at[mixed]
            begin, count = _runs(x["list"])
        n = x["n"].astype(np.int64)
        size = np.zeros(len(sig), np.uint16)
        size[at] = x["n"]
        high = size_high(size)
        # Partners follow in the list while their size fits: a range of positions for each node.
        # Codes rise with the size, so one search over (list number, code) finds the ends of all lists.
        number = np.repeat(np.arange(len(begin)), count)
        limit = size_high(x["n"]) * DEN // NUM
        shift = np.maximum(np.floor(np.log2(np.maximum(limit, 1))).astype(np.int64) - 9, 0)
        stop = np.searchsorted(number * 65536 + n, number * 65536 + np.minimum((shift << 10) + (limit >> shift), 65535), side="right")
        partners = np.maximum(stop - np.arange(len(x)) - 1, 0)
        upto = np.cumsum(partners)
        kept, weight, i = np.zeros(0, np.int64), np.zeros(0), 0
        while i < len(x):  # in blocks of bounded size
            before = int(upto[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + BLOCK)))
            p = np.repeat(np.arange(i, j), partners[i:j])
            q = p + 1 + np.arange(len(p)) - np.repeat(upto[i:j] - partners[i:j] - before, partners[i:j])
            p, q = at[p], at[q]
            apart = klass[p] != klass[q]
            code = np.setdiff1d(np.unique(np.minimum(p, q)[apart] * big + np.maximum(p, q)[apart]), tried, assume_unique=True)
            p, q = code // big, code % big
            d, both = drawn.differing(p, q), high[p] + high[q]
            fine = (NUM + DEN) * d <= both
            # The same in all homes: by the share that differs, then by the names.
            kept, first = np.unique(np.concatenate([kept, code[fine]]), return_index=True)
            weight = np.concatenate([weight, (d / np.maximum(both, 1))[fine]])[first]
            if len(kept) and k:
                least = forests(klass[kept // big], klass[kept % big], weight, k)
                kept, weight = kept[least], weight[least]
            i = j
        a, b = sig[kept // big], sig[kept % big]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "q": pa.array(a, pa.int64())})

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that their sketches do not rule out."""
    for b in batches:
        n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
        d = np.array([differing(x, y) for x, y in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist())], np.int64)
        yield b.select(["a", "b", "q"]).filter(pa.array((NUM + DEN) * d <= n + m))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sigs, items = [], []
        for sig, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = shingle_hashes(t)
            if len(s) and _sig(s) == sig:  # another row of the same doc_id may hold another text
                sigs.append(sig)
                items.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(items, pa.binary())], names=["sig", "items"])


def _verify(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links of a part that reach the threshold, without those whose ends are joined by other links of the part."""
    own = {s: np.frombuffer(x, np.uint64) for s, x in zip(sets.column("sig").to_pylist(), sets.column("items").to_pylist())}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.get(x, x)) != x:
            root[x] = root.get(r, r)
            x = r
        return x

    out = []
    for p, q in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        u, v = own.get(p), own.get(q)
        if u is None or v is None or (rp := find(p)) == (rq := find(q)):
            continue
        at = np.searchsorted(v, u)
        common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
        if 100 * common >= 75 * (len(u) + len(v) - common):
            root[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


class NearJoin:
    """``NearJoin(docs).result()``: rows (doc_id, n_shingles, component_id)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def _verified(self, candidates: DataFrame, reps: DataFrame, parts: int, sketched: bool) -> DataFrame:
        """The links among candidate pairs (a, b, q), by sketches (unless these have been ``sketched``) and then by whole sets.

        A pair is verified in the part of its end ``q`` and, where ``q`` has many partners, of a share of them: no more
        than two sets travel for a pair, and no task gets all partners of one node.
        """
        pairs = candidates
        if not sketched:
            ends = small(cut(candidates.select(F.explode(F.array("a", "b")).alias("sig")).distinct()), 500_000)
            some = cut(reps.select("sig", "n", "sketch").join(ends, "sig", "left_semi"))
            a = some.select(F.col("sig").alias("a"), "n", F.col("sketch").alias("sx"))
            b = some.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sy"))
            pairs = candidates.join(a, "a").join(b, "b").select("a", "b", "q", "n", "m", "sx", "sy").mapInArrow(_similar, "a long, b long, q long")
        other = F.pmod(F.xxhash64(F.when(F.col("q") == F.col("a"), F.col("b")).otherwise(F.col("a"))), F.lit(parts))
        pairs = cut(pairs.select("a", "b", F.pmod(F.xxhash64("q", other), F.lit(parts)).cast("int").alias("part")))
        needs = cut(pairs.select("part", F.explode(F.array("a", "b")).alias("sig")).distinct())
        want = cut(needs.select("sig").distinct().join(reps.select("sig", "doc_id"), "sig"))
        texts = self.docs.join(small(want, 500_000), "doc_id").select("sig", "text")
        sets = texts.mapInArrow(_sets, "sig long, items binary").groupBy("sig").agg(F.first("items").alias("items"))
        sets = sets.join(needs, "sig").select("part", "sig", "items")
        return cut(sets.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(_verify, "a long, b long"))

    @staticmethod
    def _partners(stars: DataFrame) -> DataFrame:
        return stars.where("block is not null").groupBy("part").applyInArrow(_chosen, "a long, b long, q long").dropDuplicates(["a", "b"])

    def result(self) -> DataFrame:
        spark, docs = self.spark, self.docs
        size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        shingles = (size[0] or 0) // 5 + size[1] + 1  # about: words are longer than four bytes with their blanks
        ranges = n_ranges(spark, shingles * 3, 8 << 20)
        # The hash for counting has at least as many values as there are shingles, so few rare ones fall together; a gap
        # takes two bytes until batches of 1000 texts leave larger ones.
        bits = min(max(32, shingles.bit_length()), 60)
        kind = np.uint16 if (1 << bits) / 300_000 < 32768 else np.uint32
        seen = docs.mapInArrow(_profiles(ranges, bits, kind), "part int, doc_id long, n long, sig long, sketch binary, block binary")
        seen = cut(seen.groupBy("part").applyInArrow(_frequent(kind), "doc_id long, n long, sig long, sketch binary, h long, df long, df2 long"))
        meta = seen.where("n is not null").select("doc_id", "n", "sig")
        # Bounded: one number for each size up to 4096 and one for what is above.
        sizes = {r[0]: r[1] for r in meta.where("n > 0").groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*")).collect()}
        total = meta.agg(F.sum("n")).first()[0] or 0
        df, df2 = seen.where("h < 0").agg(F.sum("df"), F.sum("df2")).first()
        # About the HOT most frequent: all above a frequency that the counts of frequencies give (one row for each size of
        # frequency, in eighths of a power of two).
        grade = F.floor(F.log2(F.col("df").cast("double")) * 8).cast("int")
        held, floor_ = 0, None
        for g, c in sorted(((r[0], r[1]) for r in seen.where("h >= 0 and df > 0").groupBy(grade.alias("g")).agg(F.count("*")).collect()), reverse=True):
            if held + c > HOT:
                break
            held, floor_ = held + c, g
        top = seen.where(F.lit(False) if floor_ is None else (F.col("h") >= 0) & (grade >= floor_)).select("h", "df").toArrow()
        h, d = top.column("h").to_numpy().astype(np.uint64), top.column("df").to_numpy()
        o = np.argsort(h)
        hot = spark.sparkContext.broadcast((h[o], d[o], np.uint64(64 - bits)) if len(h) else ())
        boundary = self.boundary(sizes, (df2 or 0) / max(df or 0, 1))
        spread = n_ranges(spark, total * 5, 24 << 20)
        posts = docs.select("text").mapInArrow(_postings(spread, hot, boundary), "part int, block binary")
        lists = cut(posts.groupBy("part").applyInArrow(_shared(spread), "home int, block binary"))
        reps = cut(seen.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        starred = "part int, block binary, sig long"
        first = cut(lists.groupBy("home").applyInArrow(_starred(spread, 0), starred))
        homes = first.where("sig is not null").select(F.col("part").alias("home"), "sig")
        links, comp, tried = None, None, None
        for salt in range(STAR_ROUNDS + 2):
            if salt:
                degree = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
                linked = comp.withColumnRenamed("id", "sig").join(degree, "sig", "left").select("sig", "component", F.coalesce("links", F.lit(0)).alias("links"))
            if salt == 0:
                pairs = self._partners(first)
            elif salt < STAR_ROUNDS:
                stars = lists.groupBy("home").cogroup(homes.join(linked, "sig").groupBy("home")).applyInArrow(_starred(spread, salt), starred)
                pairs = self._partners(stars).join(tried, ["a", "b"], "left_anti")
            else:
                drawn = homes.join(reps.select("sig", "sketch").join(linked, "sig", "left").select("sig", "sketch", F.coalesce("component", "sig").alias("component")), "sig")
                known = homes.join(tried.select(F.col("a").alias("sig"), F.col("b").alias("other")), "sig")
                nodes = drawn.withColumn("other", F.lit(None).cast("long")).unionByName(known, allowMissingColumns=True)
                pairs = lists.groupBy("home").cogroup(nodes.groupBy("home")).applyInArrow(_cross(FORESTS if salt == STAR_ROUNDS else None), "a long, b long, q long").distinct()
            pairs = cut(pairs)
            found = self._verified(pairs, reps, spread, salt >= STAR_ROUNDS)
            links = found if links is None else links.union(found)
            tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
            comp = cut(components(links))
        named = cut(join_one(meta, comp.withColumnRenamed("id", "sig"), "sig").select("doc_id", "n", F.coalesce("component", "sig").alias("node")))
        least = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        return join_one(named, least, "node").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))

    @staticmethod
    def boundary(sizes: dict[int, int], length: float) -> int:
        """The set size from which lists are scanned: least estimated number of entries made and scanned."""

        def at(x: int) -> float:
            cost = 0.0
            for n, m in sizes.items():
                p = n - -(-NUM * n // DEN)
                cost += m * (min(n, p + 2) * (min(n, p + 2) - 1) / 2 if n < x else 0)
                cost += m * ((p + 1) * (1 + length) if DEN * n >= NUM * x else 0)
            return cost

        return min(range(4, 65), key=at)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Classes of near copies of ``docs`` (doc_id, text): rows (doc_id, n_shingles, component_id)."""
    return NearJoin(docs).result()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each class of near copies.

    The row kept is the one of the least doc_id and then of the least hash of its text.  Rows of one doc_id with
    unrelated texts are documents of their own, and so are rows without a doc_id: the join sees each distinct
    (doc_id, text) under a number of its own, and equal rows once.
    """
    rows, key = keyed(docs)
    classes = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("component_id").alias("class"))
    ids = rows.groupBy(key).agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("c"))
    classes = cut(classes.distinct().join(ids, key))
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("k"))).alias("o")).select(F.col("o.k").alias(key))
    gone = small(cut(classes.join(first, key, "left_anti").select(key)), 1_000_000)
    again = small(cut(classes.where("c > 1").join(first, key, "left_semi").select(key)), 1_000_000)
    left = rows.join(gone, key, "left_anti")
    once = left.join(again, key, "left_semi").dropDuplicates([key])
    return left.join(again, key, "left_anti").unionByName(once).select(*docs.columns)
