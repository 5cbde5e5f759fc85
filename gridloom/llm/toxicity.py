"""Toxicity by Levenshtein automata run over a lexicon trie, with context windows.

*Lexicon.*  From labelled rows outside the held-out fold, each word and each word stem (prefix of four letters or
more) gets the log-odds of its document frequencies under the two labels.  Words and stems that are much likelier
under label 1 form the lexicon, a trie in which stems match all their continuations.

*Matching.*  A Levenshtein automaton is intersected with the trie: its states are sets of (trie node, edits), made
deterministic as texts need them, so a word costs one move a letter.  Words of three to seven letters may differ by one
edit, longer ones by two, the first letter included; a swap of two neighbours is one edit.  All words of the lexicon
of four letters or more may be misspelled (stems match their continuations only).

*Context.*  A match is quoted when quotation marks stand on both sides of it, or a reporting cue near it, within a
window of words; a quoted match adds to no other feature than the number of quoted ones.  The features of a document (exact,
stem, fuzzy and quoted matches; density, weight and distinct terms of those that are not quoted; address words near
these) enter a logistic regression fitted in numpy on the training rows.  Signs are fixed: no match may lower a score, and
no quoted one may raise it (a weight of the wrong sign is left out and the rest fitted again).

The fit takes at most ``MAX_TRAIN`` labelled rows for each label (the bound is this parameter; rows are taken in the
order of a hash of their id) and of a text of more than ``MAX_TRAIN_BYTES`` so many bytes in ``PASSAGES`` passages spread
over it; scores cover every whole text.

Edge cases: null and empty texts get the score of a document without any match; null labels are not used; without
labels of both kinds every score is the prior (0 without any label); null doc_id is scored and not held out;
repeated label rows count once; a text of any length is scored in work linear in it; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, keyed

MAX_TRAIN, MAX_TRAIN_BYTES, PASSAGES = 3000, 50_000, 8
#: Words whose match a task remembers; a matter of speed only.
MAX_KNOWN = 150_000
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")
#: Words that report speech, and words of direct address.
CUES = frozenset("said says wrote quoted called quote dijo dice escribió dit écrit sagte schrieb zitiert".split())
ADDRESS = frozenset("you your you're tu vous tú usted du sie ihr".split())
STEM, WINDOW, MIN_DOCS = 4, 6, 3
N_FEATURES = 9


class Trie:
    """Lexicon trie in arrays: children, weight of the term and of the stem that end at a node."""

    def __init__(self, terms=()):
        self.next: list[dict[str, int]] = [{}]
        self.end, self.stem, self.fuzzy = [0.0], [0.0], [0.0]
        for term, weight, stem, fuzzy in terms:
            node = 0
            for ch in term:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    for x in (self.end, self.stem, self.fuzzy):
                        x.append(0.0)
                node = child
            kept = self.stem if stem else self.end
            kept[node] = max(kept[node], weight)
            if fuzzy:
                self.fuzzy[node] = weight
        # Nodes on the way to a term that may be misspelled; the automaton walks these only.
        self.leads = [bool(x) for x in self.fuzzy]
        for node in range(len(self.next) - 1, -1, -1):
            self.leads[node] |= any(self.leads[c] for c in self.next[node].values())


class Automaton:
    """Intersection of the Levenshtein automaton of ``limit`` edits with the trie, made deterministic as it is used.

    A state is a set of (trie node, edits so far), where ((trie node, letter), edits) stands for the first half of a
    swap that reaches the node with that letter.  The first ``MAX_STATES`` states are kept with their moves under a
    number; later ones are worked out where a word needs them.  A state without members is dead and ends the walk.
    """

    MAX_STATES = 20_000

    def __init__(self, trie: Trie, limit: int):
        self.trie, self.limit = trie, limit
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[float] = []
        self.first = self._state({0: 0} if self.trie.leads[0] else {})

    def _state(self, nodes: dict) -> int | dict:
        t, todo = self.trie, [x for x in nodes.items() if type(x[0]) is int]
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            if e < self.limit:
                for c in t.next[node].values():
                    if t.leads[c] and nodes.get(c, 9) > e + 1:
                        nodes[c] = e + 1
                        todo.append((c, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        got = self.ids.get(key)
        if got is None:
            if len(self.sets) >= self.MAX_STATES:
                return nodes
            got = self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            self.found.append(self._best(nodes))
        return got

    def _best(self, nodes: dict) -> float:
        fuzzy = self.trie.fuzzy
        return max((fuzzy[n] / (1 + e) for n, e in nodes.items() if type(n) is int and fuzzy[n]), default=0.0)

    def _step(self, nodes: dict, ch: str) -> int | dict:
        t, out = self.trie, {}
        for node, e in nodes.items():
            if type(node) is tuple:
                if node[1] == ch and out.get(node[0], 9) > e:  # second half of a swap
                    out[node[0]] = e
                continue
            child = t.next[node].get(ch)
            if child is not None and t.leads[child] and out.get(child, 9) > e:
                out[child] = e
            if e < self.limit:
                if out.get(node, 9) > e + 1:  # a letter too many
                    out[node] = e + 1
                for x, c in t.next[node].items():  # another letter, or the first half of a swap
                    if t.leads[c]:
                        if out.get(c, 9) > e + 1:
                            out[c] = e + 1
                        c = t.next[c].get(ch)
                        if c is not None and x != ch and t.leads[c] and out.get((c, x), 9) > e + 1:
                            out[c, x] = e + 1
        return self._state(out)

    def weight(self, word: str) -> float:
        state = self.first
        for ch in word:
            if type(state) is dict:
                state = self._step(state, ch)
                continue
            if state < 0:
                return 0.0
            new = self.moves[state].get(ch)
            if new is None:
                new = self._step(self.sets[state], ch)
                if type(new) is int:
                    self.moves[state][ch] = new
            state = new
        return self._best(state) if type(state) is dict else self.found[state] if state >= 0 else 0.0


class Matcher:
    """(kind, weight) of a word: kind 0 none, 1 a term, 2 a continuation of a stem, 3 a misspelled term."""

    def __init__(self, terms):
        self.trie = Trie(terms)
        self.one, self.two = Automaton(self.trie, 1), Automaton(self.trie, 2)
        self.known: dict[str, tuple[int, float]] = {}

    def __call__(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            got = self._match(word)
            if len(self.known) < MAX_KNOWN:
                self.known[word] = got
        return got

    def _match(self, word: str) -> tuple[int, float]:
        t, node, stem = self.trie, 0, 0.0
        for ch in word:
            node = t.next[node].get(ch, -1)
            if node < 0:
                break
            if t.stem[node] > stem:
                stem = t.stem[node]
        if node > 0 and t.end[node]:
            return 1, t.end[node]
        if stem:
            return 2, stem
        if len(word) < 3:
            return 0, 0.0
        w = (self.one if len(word) < 8 else self.two).weight(word)
        return (3, w) if w else (0, 0.0)


def lexicon(rows: list[tuple[str, int]]) -> list[tuple[str, float, bool, bool]]:
    """(term, weight, is a stem, may be misspelled): much likelier under label 1; words of four letters or more may be misspelled."""
    n = Counter(y for _, y in rows)
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for text, y in rows:
        seen = {w for w in WORD.findall(text.lower()) if w not in QUOTES}
        words[y].update(seen)
        stems[y].update({w[:k] for w in seen for k in range(STEM, min(len(w), 12))})
    out, bar = [], math.log(max(len(words[1]) + len(stems[1]), 2))
    for kind, (neg, pos) in ((False, words), (True, stems)):
        for w, c in pos.items():
            if c < MIN_DOCS:
                continue
            # Log-likelihood ratio against equal shares; the bar follows the number of terms that are tried.
            m, share = neg[w], n[1] / (n[0] + n[1])
            gain = c * math.log(c / ((c + m) * share)) + (m * math.log(m / ((c + m) * (1 - share))) if m else 0)
            if gain < bar:
                continue
            odds = math.log((c + 0.5) / (n[1] + 1)) - math.log((neg[w] + 0.5) / (n[0] + 1))
            if odds > 2.5 and c > 4 * neg[w]:
                out.append((w, odds, kind, not kind and len(w) >= 4))
    return out


def features(match: Matcher, text: str | None) -> list[float]:
    words = WORD.findall(text.lower()) if text else []
    got, quoted, kinds, terms, total = [], 0, [0, 0, 0, 0], set(), 0.0
    known = match.known
    for i, w in enumerate(words):
        k = known.get(w) or match(w)
        if k[0]:
            got.append((i, w, k))
    addressed = 0
    for i, w, (kind, weight) in got:
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        if (any(x in QUOTES for x in words[max(0, i - WINDOW) : i]) and any(x in QUOTES for x in words[i + 1 : i + WINDOW + 1])) or any(x in CUES for x in around):
            quoted += 1
            continue
        kinds[kind] += 1
        terms.add(w)
        total += weight
        addressed += any(x in ADDRESS for x in around)
    n = max(len(words), 1)
    return [1.0, *(math.log1p(x) for x in kinds[1:]), math.log1p(quoted), math.log1p(len(terms)), math.log1p(total), math.log1p(1000 * sum(kinds) / n), math.log1p(addressed)]


#: The sign that the weight of each feature may have (0: any).
SIGNS = np.array([0, 1, 1, 1, -1, 1, 1, 1, 1])


def signed_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``logistic`` with the signs of ``SIGNS``: the weight that is most against its sign is left out, until none is."""
    use = np.ones(len(SIGNS), bool)
    while True:
        w = np.zeros(len(SIGNS))
        w[use] = logistic(x[:, use], y)
        against = w * SIGNS
        if against.min() >= 0:
            return w
        use[int(against.argmin())] = False


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, terms, weights, prior):
        self.terms, self.weights, self.prior = terms, weights, prior

    @classmethod
    def fit(cls, rows: list[tuple[str | None, int]]) -> "ToxicityModel":
        """From (text, label) rows.  The lexicon is built on one half and weighted on the other."""
        rows = [(t or "", y) for t, y in rows]
        n1 = sum(y for _, y in rows)
        if not rows or n1 in (0, len(rows)):
            return cls([], None, n1 / len(rows) if rows else 0.0)
        x, y = [], []
        for a, b in ((rows[::2], rows[1::2]), (rows[1::2], rows[::2])):
            if len({y for _, y in a}) == 2:
                match = Matcher(lexicon(a))
                x += [features(match, t) for t, _ in b]
                y += [v for _, v in b]
        terms = lexicon(rows)
        if not x:
            match = Matcher(terms)
            x, y = [features(match, t) for t, _ in rows], [v for _, v in rows]
        return cls(terms, signed_logistic(np.array(x), np.array(y, float)), n1 / len(rows))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, folds: int = 5) -> DataFrame:
    """Rows (doc_id, y, text): at most ``max_rows`` for each label outside the held-out fold, by a hash of the id."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.where(~held_out(folds))
    picked = None
    for v in (0, 1):
        one = y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = one if picked is None else picked.union(one)
    picked = F.broadcast(picked)  # at most 2 * max_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    size = MAX_TRAIN_BYTES // PASSAGES // 4  # characters, of up to four bytes
    step = F.floor((F.length("text") - size) / (PASSAGES - 1)).cast("int")
    some = F.array_join(F.transform(F.array(*map(F.lit, range(PASSAGES))), lambda k: F.substring("text", k * step + 1, F.lit(size))), "\n")
    texts = texts.withColumn("text", F.when(F.octet_length("text") > MAX_TRAIN_BYTES, some).otherwise(F.col("text")))
    return texts.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> ToxicityModel:
    """The model of the training rows, fitted in one task (they are bounded); only terms and weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("y").to_pylist())]
        model = ToxicityModel.fit([(t, y) for _, _, t, y in sorted(rows, key=lambda r: r[:2])])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.terms, model.weights, model.prior))], pa.binary())], names=["model"])

    rows = training_rows(docs, labels, max_rows).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y")
    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return ToxicityModel(*pickle.loads(made[0])) if made else ToxicityModel.fit([])


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``; whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w, prior = sent.value
        match = Matcher(terms)
        for b in batches:
            if w is None:
                s = [prior] * b.num_rows
            else:
                x = np.array([features(match, t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
                s = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document."""
    model = fitted(docs, labels, max_rows)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, those without a doc_id included."""
    model = fitted(docs, labels)
    rows, key = keyed(docs)
    bad = cut(score(rows.select(F.col(key).alias("doc_id"), "text"), model).where("score >= 0.5").select(F.col("doc_id").alias(key)).distinct())
    return rows.join(bad, key, "left_anti").select(*docs.columns)
