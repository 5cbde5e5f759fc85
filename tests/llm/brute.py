"""Plain versions of the operators, written from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def pii(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(BASE[kind], text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii_digest(text):
    s = pii(text)
    n = Counter(k for k, _, _ in s)
    return (*(n[k] for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())


def repeats(rows, length=200):
    """rows: (id, text).  Every byte covered by a string that starts twice."""
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        for k in range(len(d) - length + 1):
            seen[hash(d[k : k + length])] += 1
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[hash(d[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near(rows):
    s = {i: shingles(t) for i, t in rows}
    inv = defaultdict(list)
    for i, x in s.items():
        for g in x:
            inv[g].append(i)
    common = Counter((a, b) for v in inv.values() for k, a in enumerate(v) for b in v[k + 1 :])
    pairs = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(s[a]) + len(s[b]) - n)]
    comp = union(pairs, s)
    return [(i, len(s[i]), comp[i]) for i in s]


def decontaminate(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for doc, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[g]
        ids = sorted({str(i) for i in ids if i is not None})
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def vectors(rows, limit=0.98):
    """rows: (id, vector, label)."""
    ok = {}
    for i, v, y in rows:
        if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (v, y)
    links = defaultdict(set)
    for a, (u, y) in ok.items():
        for b, (v, z) in ok.items():
            if a < b and y == z and len(u) == len(v):
                dot = sum(p * q for p, q in zip(u, v))
                if dot / math.sqrt(sum(p * p for p in u)) / math.sqrt(sum(q * q for q in v)) >= limit:
                    links[a].add(b)
                    links[b].add(a)
    comp = union([(a, b) for a in links for b in links[a]], [r[0] for r in rows])
    return [(i, len(links[i]), comp[i], comp[i] == i) for i, _, _ in rows]


def best_fit(lengths, capacities, overhead, quadratic=8192):
    """Item by item, longest first."""
    caps, bins = sorted(capacities), []
    todo = sorted((x for x in lengths if x), reverse=True)
    k = 0
    while k < len(todo):
        n = todo[k]
        fits = [b for b in bins if b[0] - b[1] >= n]
        if not fits:
            same = sum(x == n for x in todo[k:])
            costs = {}
            for c in caps:
                if c >= n:
                    per = min(c // n, same)
                    count = -(-same // per)
                    small = sum(x for x in todo[k:] if x < n and x <= c - per * n)
                    held = min(same * n + min(count * (c - per * n), small), count * c)
                    costs[c] = count * (overhead + c + c * c / quadratic) / held
            cap = min(costs, key=lambda c: (costs[c], c))
            bins += [[cap, 0] for _ in range(-(-same // (cap // n)))]
            continue
        b = min(fits, key=lambda b: b[0] - b[1])
        b[1] += n
        k += 1
    return sorted((b[1], next(c for c in caps if c >= b[1])) for b in bins)


def cheapest_packing(lengths, capacities, cost):
    """The least total cost of bins that hold all items: every partition is tried."""
    caps = sorted(capacities)
    best = [float("inf")]

    def place(k, bins):
        total = sum(cost(next(c for c in caps if c >= b)) for b in bins)
        if total >= best[0]:
            return
        if k == len(lengths):
            best[0] = total
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= caps[-1]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]
