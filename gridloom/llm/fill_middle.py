"""Fill-in-middle: texts cut into units at zero-width boundaries, and their middle moved to the end.

Method: a unit grammar is a list of character classes and the pairs of neighbouring classes that stay together.  It is
translated to a regex of zero width that holds between two characters of any other pair; Spark's ``split`` by it keeps
every character.  An empty text has no units and is handled apart, as ``split`` would give one empty piece.

A boundary depends on the two characters beside it only, so a text is split in chunks: whether the edge of a chunk is a
boundary is seen by splitting the two characters around it.  A chunk has ``CHUNK`` characters, or a ``CHUNKS``-th of a very
long text; its pieces are all that is in memory at once, and only the chunks that hold a cut are split a second time.

Everything is built-in expressions.  Edge cases: a null or empty text has no units and is plain; a text that holds a mark
is plain; a null id is the empty string in the hash; rows that share an id (and so the hash) are handled one by one;
an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, running, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Least number of characters that are split at once, and most chunks of a text.
CHUNK, CHUNKS = 2048, 256


@dataclass(frozen=True)
class Units:
    """Character classes that share out all characters, and the pairs (left, right) of them with no boundary between."""

    classes: tuple[str, ...]
    joined: tuple[tuple[int, int], ...] = ()

    def boundary(self) -> str:
        """The regex of zero width between two units."""
        apart = [(a, b) for a in range(len(self.classes)) for b in range(len(self.classes)) if (a, b) not in self.joined]
        return "|".join(f"(?<={self.classes[a]})(?={self.classes[b]})" for a, b in apart)


CHARACTERS = Units((r"(?s:.)",))
#: Runs of white space and runs of anything else.
WORDS = Units((r"\s", r"\S"), ((0, 0), (1, 1)))
#: Lines with their line feed.
LINES = Units((r"\n", r"[^\n]"), ((1, 0), (1, 1)))


def _pieces(text: Column, units: Units, start, length) -> Column:
    return F.split(F.substring(text, start, length), units.boundary(), -1)


def _chunk(text: Column) -> Column:
    return F.greatest(F.lit(CHUNK), F.ceil(F.length(text) / CHUNKS).cast("int"))


def _continues(text: Column, units: Units, start: Column) -> Column:
    """1 if the chunk after ``start`` characters begins inside a unit, else 0."""
    if not units.joined:
        return F.lit(0)
    return F.when((start > 0) & (F.size(_pieces(text, units, start, F.lit(2))) == 1), 1).otherwise(0)


def unit_counts(text: Column, units: Units = CHARACTERS) -> Column:
    """How many units begin in each chunk of ``text`` (not null)."""
    one = lambda c: F.size(_pieces(text, units, c * _chunk(text) + 1, _chunk(text))) - _continues(text, units, c * _chunk(text))
    last = F.ceil(F.length(text) / _chunk(text)).cast("int") - 1
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.expr("cast(array() as array<int>)"))


def characters_before(text: Column, units: Units, before: Column, n: Column, k: Column) -> Column:
    """Characters in the first ``k`` of ``n`` units; ``before`` has the units that begin before each chunk."""

    def inside(c: Column) -> Column:
        start = c * _chunk(text)
        own = (k - F.get(before, c)).cast("int") + _continues(text, units, start)
        return start + F.length(F.array_join(F.slice(_pieces(text, units, start + 1, _chunk(text)), F.lit(1), own), ""))

    return F.when(k >= n, F.length(text)).otherwise(let(F.size(F.filter(before, lambda b: b <= k)) - 1, inside))


def fill_in_middle(docs: DataFrame, units: Units = CHARACTERS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``n_units``, ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``.

    Cuts and form follow the sha256 of seed and doc_id.  A column of ``docs`` that has one of these names is replaced.
    """
    made = ("n_units", "form", "prefix", "middle", "suffix", "output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    t, h, b, n, c1, c2 = (unused(docs, f"__{x}") for x in ("t", "h", "b", "n", "c1", "c2"))
    text, marks = F.col(t), F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marks = marks | F.contains(text, F.lit(mark))
    draw = lambda k: F.conv(F.substring(F.col(h), 8 * k + 1, 8), 16, 10).cast("long")
    one = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias(h))
    one = one.withColumn(b, unit_counts(text, units)).withColumn(n, F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    x, y = draw(0) % (F.col(n) + 1), draw(1) % (F.col(n) + 1)
    form = F.when((F.col(n) == 0) | marks | (draw(2) % 100 >= 100 - plain_percent), "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    one = one.withColumn("form", form).withColumn(b, running(F.col(b), lambda s, v: s + v))
    cut_at = lambda k: F.when(F.col("form") != "plain", characters_before(text, units, F.col(b), F.col(n), k)).cast("int")
    one = one.withColumn(c1, cut_at(F.least(x, y))).withColumn(c2, cut_at(F.greatest(x, y)))
    begin, end = F.col(c1), F.col(c2)
    one = one.select(*kept, t, F.col(n).alias("n_units"), "form", F.substring(text, F.lit(1), begin).alias("prefix"), F.substring(text, begin + 1, end - begin).alias("middle"), F.substring(text, end + 1, F.length(text)).alias("suffix"))
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    return one.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", spm).otherwise(psm)).drop(t)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts stand between the first places of the three marks."""
    at = lambda mark: F.locate(mark, output)
    part = lambda first, last: F.substring(output, at(first) + 3, at(last) - at(first) - 3)
    end = F.substring(output, at(MIDDLE) + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(PREFIX, MIDDLE), end, part(SUFFIX, PREFIX))).otherwise(F.concat(part(PREFIX, SUFFIX), end, part(SUFFIX, MIDDLE)))


def middle_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``fill_in_middle`` by code points, and of the text read back from its output."""
    out = fill_in_middle(docs)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
