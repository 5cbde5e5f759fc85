"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

*Seeds* are the matches of four base patterns (email, ip, card with Luhn check, phone), leftmost and not overlapping
for each kind; failing matches are dropped without retries.  *Candidates* are other identifiers: words with an @ or five
digits, and runs of digit groups with single blanks between (with dots, dashes and parentheses) of five digits or more.
Every occurrence has two lexical patterns: the word before and the word after, unless that is a match itself.

The pattern-instance graph is scored iteratively: a pattern's confidence for a kind is the smoothed share of its
occurrences whose instances are believed to be of the kind, and the belief in an unlabelled instance is the noisy-or
of the confidence of its patterns.  Patterns that end above ``CONFIDENT`` with ``SUPPORT`` distinct seeds extract
candidates as further spans of kind ``x_email``, ``x_ip``, ``x_card`` or ``x_phone``; base spans always stay.

Positions are code points; they come from the pieces between matches by running totals in chunks, so the work is linear
in the text, a text is scanned once or twice for each pattern, and texts without an @ or a digit are not scanned at all.
Patterns and instances that many occurrences share are joined by broadcast (``join_one``).

Edge cases: null text is empty; null doc_id is a row of its own; repeated rows give repeated results; an empty table
gives an empty result; very long runs of digits or word characters cannot backtrack (possessive quantifiers); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_one, keyed, let, running, unused

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions with possessive quantifiers; a start inside a run is only tried where a match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Stand-ins for a digit and an @ of a base match, so that candidates of a text with base matches struck out are the same.
STRUCK = ("\ue000", "\ue001")
#: Two or more groups of digits with single blanks between, or else a word with a digit or an @.
CANDIDATE = r"(?<!\S)(?:[().+-]*+[0-9][0-9().+-]*+(?: [().+-]*+[0-9][0-9().+-]*+)++(?!\S)|[^\s0-9@]*+[0-9@]\S*+)"
CONFIDENT, SUPPORT, SMOOTH, ROUNDS = 0.8, 5, 1.0, 2
#: Code points of a piece of text.
PIECE = 1024
#: Spans (of 12 bytes) that masking sends to every task; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
SPAN = "array<struct<kind:int,start:int,end:int,value:string,prev:string,next:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit completes the doubled-alternate sum to a multiple of ten."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), term), F.lit(0), lambda a, b: a + b)
    return (n > 0) & (total % 10 == 0)


def passes(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    n = F.length(_digits(v))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(v))).otherwise(False)
    return (n >= 9) & (n <= 15)


def pieces(text: Column, pattern: str, guard: str) -> Column:
    """Struct of the matches of ``pattern`` and the texts between them."""
    found = text.rlike(guard)
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("hits"), F.when(found, F.split(text, pattern, -1)).otherwise(none).alias("gaps"))


def located(parts: Column, kind: int) -> Column:
    """Array of spans (kind, start, end, value, prev, next) of all matches; prev and next are the words around."""

    def spans(p: Column) -> Column:
        lens = F.transform(p.hits, lambda v, i: F.length(v) + F.length(F.get(p.gaps, i)))

        def one(z: Column) -> Column:
            start = z.at + F.length(z.gap)
            prev = F.reverse(F.regexp_extract(F.reverse(z.gap), r"^\s*(\S+)", 1))
            nxt = F.regexp_extract(z.after, r"^\s*(\S+)", 1)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(z.hit)).alias("end"), z.hit.alias("value"), F.lower(prev).alias("prev"), F.lower(nxt).alias("next"))

        zipped = F.arrays_zip(p.hits.alias("hit"), F.slice(p.gaps, 1, F.size(p.hits)).alias("gap"), F.slice(p.gaps, 2, F.size(p.hits)).alias("after"), running(lens, lambda a, b: a + b).alias("at"))
        return F.transform(zipped, one)

    return F.when(F.size(parts.hits) > 0, let(parts, spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def struck(parts: Column, kind: str) -> Column:
    """The text with the digits and @ of passing matches struck out."""

    def out(v: Column) -> Column:
        return F.when(passes(kind, v), F.replace(F.regexp_replace(v, "[0-9]", STRUCK[0]), F.lit("@"), F.lit(STRUCK[1]))).otherwise(v)

    return F.array_join(F.transform(parts.gaps, lambda g, i: F.concat(g, F.coalesce(out(F.get(parts.hits, i)), F.lit("")))), "")


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: passes(kind, s.value))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """One pass: rows (doc_id, key, base, more) with the base spans and the candidates outside them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), *[pieces(F.col("text"), PATTERNS[k], GUARDS[k]).alias(f"p{i}") for i, k in enumerate(KINDS)], pieces(F.col("text"), CANDIDATE, r"[0-9@]").alias("pc"))
    base = [_passing(located(F.col(f"p{i}"), i), k) for i, k in enumerate(KINDS)]
    rows = rows.select("doc_id", "key", F.concat(*base).alias("base"), *[f"p{i}" for i in range(len(KINDS))], "pc", located(F.col("pc"), -1).alias("more"))
    # The same candidates of the text with the base matches of one kind struck out tell which ones meet such a match.
    again = [F.when(F.exists("base", lambda s: s.kind == F.lit(i)), F.regexp_extract_all(struck(F.col(f"p{i}"), k), F.lit(CANDIDATE), F.lit(0))).alias(f"h{i}") for i, k in enumerate(KINDS)]
    rows = rows.select("doc_id", "key", "base", "more", *again)
    alike = [F.coalesce(F.col(f"h{i}"), F.transform("more", lambda s: s.value)).alias(f"h{i}") for i in range(len(KINDS))]
    strong = F.filter(F.arrays_zip(F.col("more").alias("s"), *alike), lambda z: ((F.length(_digits(z.s.value)) >= 5) | z.s.value.contains("@")) & ~F.concat(*[z[f"h{i}"] for i in range(len(KINDS))]).rlike("[" + "".join(STRUCK) + "]"))
    return rows.select("doc_id", "key", "base", F.transform(strong, lambda z: z.s).alias("more"))


def bootstrap(scanned: DataFrame) -> DataFrame:
    """Spans (key, kind, start, end) that confident patterns discover; scored over the whole pattern-instance graph."""

    def occurrences(column: str) -> DataFrame:
        one = scanned.select("key", F.explode(column).alias("s")).select("key", "s.*")
        sides = F.array(F.struct(F.lit("L").alias("side"), F.col("prev").alias("word")), F.struct(F.lit("R").alias("side"), F.col("next").alias("word")))
        return one.select("key", "kind", "start", "end", F.lower("value").alias("inst"), F.explode(sides).alias("p")).select("key", "kind", "start", "end", "inst", F.concat("p.side", F.lit(":"), "p.word").alias("pattern")).where("length(pattern) > 2")

    seeds, loose = occurrences("base"), occurrences("more")
    edges = cut(seeds.groupBy("pattern", "inst", "kind").agg(F.count("*").alias("n")).union(loose.groupBy("pattern", "inst", "kind").agg(F.count("*").alias("n"))))
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"), *[F.count_if(F.col("kind") == i).alias(f"d{i}") for i in range(len(KINDS))])
    open_edges, belief = edges.where("kind < 0"), None
    for _ in range(ROUNDS):
        known = edges.where("kind >= 0").groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).cast("double").alias(f"k{i}") for i in range(len(KINDS))])
        if belief is not None:
            extra = join_one(open_edges, belief, "inst").where("b0 is not null").groupBy("pattern").agg(*[F.sum(F.col("n") * F.col(f"b{i}")).alias(f"k{i}") for i in range(len(KINDS))])
            known = known.union(extra).groupBy("pattern").agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(len(KINDS))])
        conf = total.join(known, "pattern").select("pattern", *[f"d{i}" for i in range(len(KINDS))], *[(F.col(f"k{i}") / (F.col("total") + SMOOTH)).alias(f"c{i}") for i in range(len(KINDS))])
        conf = cut(conf)
        miss = join_one(open_edges, conf, "pattern").where("c0 is not null").groupBy("inst").agg(*[F.sum(F.log(F.greatest(1 - F.col(f"c{i}"), F.lit(1e-9)))).alias(f"m{i}") for i in range(len(KINDS))])
        belief = cut(miss.select("inst", *[(1 - F.exp(f"m{i}")).alias(f"b{i}") for i in range(len(KINDS))]))
    best = F.array_max(F.array(*[F.struct(F.when(F.col(f"d{i}") >= SUPPORT, F.col(f"c{i}")).otherwise(0.0).alias("c"), F.lit(-i).alias("k")) for i in range(len(KINDS))]))
    sure = conf.select("pattern", best.alias("b")).where(F.col("b.c") >= CONFIDENT).select("pattern", (-F.col("b.k")).alias("found"))
    believed = belief.select("inst", F.array(*[f"b{i}" for i in range(len(KINDS))]).alias("bs"))
    hit = cut(join_one(loose, cut(sure), "pattern").where("found is not null"))
    hit = join_one(hit, believed, "inst").where(F.get("bs", F.col("found")) >= CONFIDENT)
    return hit.groupBy("key", "start", "end").agg(F.min("found").alias("found")).select("key", (F.col("found") + len(KINDS)).alias("kind"), "start", "end")


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, spans array<struct<kind,start,end>>): kinds 0-3 are base, 4-7 discovered ones."""
    scanned = cut(scan(docs))
    more = bootstrap(scanned).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    bare = F.transform("base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    return scanned.select("doc_id", "key", bare.alias("bare")).join(cut(more), "key", "left").select("doc_id", "key", F.array_sort(F.concat("bare", F.coalesce("found", none))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"x_{k}") for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s.kind), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every row of ``docs``."""
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s.kind < len(KINDS))
    return find_pii(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` (where there is one) brought up to date."""
    rows, key = keyed(docs)
    found = unused(rows, "__spans")
    spans = cut(find_pii(docs).where(F.size("spans") > 0).select(F.col("key").alias(key), F.col("spans").alias(found)).dropDuplicates([key]))
    held = spans.agg(F.sum(F.size(found) + 4)).first()[0] or 0
    rows = rows.join(F.broadcast(spans) if held <= MAX_BROADCAST else spans, key, "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *KINDS)])

    def cut_out(z: Column, a: Column, b: Column) -> Column:
        """Code points a to b of a text that is held in chunks of ``PIECE``."""
        first = F.floor(a / PIECE).cast("int")
        near = F.array_join(F.slice(z.chunks, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return near.substr(a - first * PIECE + 1, F.greatest(b - a, F.lit(0)))

    def masked(z: Column) -> Column:
        before = F.transform(F.arrays_zip(z.spans.alias("s"), running(F.transform(z.spans, lambda s: -s.back), lambda a, b: F.greatest(a, b)).alias("upto")), lambda x: F.when(x.s.start >= x.upto, F.concat(cut_out(z, x.upto, x.s.start), F.get(names, x.s.kind))).otherwise(""))
        return F.concat(F.array_join(before, ""), cut_out(z, F.array_max(F.transform(z.spans, lambda s: -s.back)), z.n))

    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.kind.alias("kind"))))
    held = F.struct(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("chunks"), F.length("text").alias("n"), ordered.alias("spans"))
    out = rows.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(let(held, masked)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
