"""Chat formatting with a grammar round trip, in DataFrame operations only.

The template is ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE`` for each turn.  A conversation is rendered, the
output is parsed again by a deterministic grammar (split at turn starts, role to the first newline, body to the turn
end), and the recovered turns are compared with the source.  Where they differ, the content is escaped: every ``<``,
run of backslashes and ``|`` gets one backslash more, which leaves no control string and is undone by taking one
away.  The parser always undoes it, so text that looks escaped already is a conflict too, and the second rendering
is identical for every text.

Edge cases: null text is empty; null role is the empty role; roles are written with %, newline and < encoded; turns
are ordered by (turn, role, text), nulls first, and repeated rows stay turns; a null conv_id is one conversation; an
empty table gives an empty result; other columns are ignored.  A conversation is one output row, so it must fit in
a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, running

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def render(turns: Column, escaped: bool) -> Column:
    one = lambda t: F.concat(F.lit(START), role_out(t.role), F.lit("\n"), escape(t.text) if escaped else t.text, F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(output: Column) -> Column:
    """Turns (role, text, body) read from rendered text; null where it is not in the grammar."""
    pieces = F.split(output, r"<\|im_start\|>", -1)
    turns = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        nl = F.instr(p, "\n")
        body = F.when((nl > 0) & p.endswith(END + "\n") & (F.length(p) - nl >= len(END) + 1), p.substr(nl + 1, F.length(p) - nl - len(END) - 1))
        ok = F.instr(body, END) == 0
        body = F.when(ok, body)
        return F.when(body.isNotNull(), F.struct(role_in(p.substr(F.lit(1), nl - 1)).alias("role"), unescape(body).alias("text"), body.alias("body")))

    read = F.transform(turns, one)
    return F.when((F.element_at(pieces, 1) == "") & ~F.exists(read, lambda t: t.isNull()), read)


def plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, formatted, parsed, escaped) of ``rows`` (conv_id, turn, role, text).

    ``parsed`` holds the turns read back from ``formatted``; ``escaped`` says whether the plain form had conflicts.
    """
    src = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("rows"))
    convs = convs.select("conv_id", plain(F.col("rows")).alias("turns"))
    first = convs.withColumn("out0", render(F.col("turns"), False))
    same = F.coalesce(plain(parse(F.col("out0"))) == F.col("turns"), F.lit(False))
    done = first.withColumn("escaped", ~same).withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("out0")))
    return done.select("conv_id", "turns", "formatted", parse(F.col("formatted")).alias("parsed"), "escaped")


def loss_mask(formatted: DataFrame) -> DataFrame:
    """Adds ``mask``: code point spans of the assistants' bodies in ``formatted``, computed from the parsed turns."""
    width = lambda t: F.length(role_out(t.role)) + F.length(t.body) + len(START) + len(END) + 2

    def spans(turns: Column) -> Column:
        start = lambda z: z.at + len(START) + F.length(role_out(z.turn.role)) + 1
        zipped = F.arrays_zip(turns.alias("turn"), running(F.transform(turns, width), lambda a, b: a + b).alias("at"))
        said = F.filter(zipped, lambda z: z.turn.role == "assistant")
        return F.transform(said, lambda z: F.struct(start(z).alias("start"), (start(z) + F.length(z.turn.body)).alias("end")))

    return formatted.withColumn("mask", let(F.col("parsed"), spans))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    said = F.array_join(F.transform(F.col("mask"), lambda m: unescape(F.col("formatted").substr(m.start + 1, m.end - m.start))), "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return loss_mask(formatted).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
