"""Chat formatting with relational operators only.

Turns are collected per conversation and range of turn numbers, sorted, and
rendered by array functions: a role header where the role changes (adjacent
turns of one role share a block), the escaped text, an end mark.  A long
conversation is many ranges, so its turns sort in many tasks; the role in
force at a range's start comes from the range before.

Rendered:  ``### role:\\n`` text ``\\n</turn>\\n`` [text ``\\n</turn>\\n`` ...]

Inside texts and roles a backslash goes before every backslash, ``</turn>``
and ``### `` (and ``:`` in roles), so a line that starts with a mark is always
the template's own and dropping those backslashes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 64
HEAD, HEAD_END, END = "### ", ":\n", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"(\\|</turn>|### {more})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_segments(turns: DataFrame, loss_role: str = LOSS_ROLE, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) rendered in ranges of turn numbers.

    One row per conversation and range: conv_id, segment, body, role (in force
    before the body; null at the start of a conversation), spans (array of
    start, length: the loss mask over the body in code points, from 0).
    Bodies in segment order make the conversation.  Null texts and roles are
    empty; a null conv_id is a conversation of its own, a null turn comes
    first; turns with one number are ordered by role, then text; repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    rows = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-(1 << 62))).alias("segment"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    made = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    made = made.withColumn("last", F.element_at("ts.role", -1))
    made = made.withColumn("role", F.lag("last").over(Window.partitionBy("conv_id").orderBy("segment")))

    def render(t: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("role")).otherwise(F.get("ts", i - 1)["role"])
        head = F.when(before.eqNullSafe(t["role"]), F.lit("")).otherwise(
            F.concat(F.lit(HEAD), escape(t["role"], "|:"), F.lit(HEAD_END)))
        return F.struct(head.alias("head"), escape(t["text"]).alias("said"), (t["role"] == loss_role).alias("loss"))

    made = made.withColumn("out", F.transform("ts", render))
    made = made.withColumn("body", F.concat_ws("", F.transform("out", lambda o: F.concat(o["head"], o["said"], F.lit(END)))))
    ends = F.aggregate(
        F.transform("out", lambda o: (F.length(o["head"]) + F.length(o["said"]) + len(END)).cast("long")),
        F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    made = made.withColumn("ends", ends)
    spans = F.transform("out", lambda o, i: F.struct(
        (F.get("ends", i) + F.length(o["head"])).alias("start"), F.length(o["said"]).cast("long").alias("length"),
        o["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
    return made.select("conv_id", "segment", "body", "role", spans.alias("spans"))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the loss spans as
    segments of (length of the segment, spans within it)."""
    parts = format_segments(turns, loss_role).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "body", "spans"))).alias("parts"))
    return parts.select(
        "conv_id", F.concat_ws("", "parts.body").alias("formatted"),
        F.transform("parts", lambda p: F.struct(F.length(p["body"]).alias("chars"), p["spans"].alias("spans"))).alias("loss"))


def read_segments(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts read back from ``format_segments``: conv_id,
    segment, turns (array of role, text), loss (array of texts), chars."""
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n"           # possessive: no recursion over a long role
    pieces = F.split("body", END, -1)
    said = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    said = said.withColumn("heads", F.transform("pieces", lambda p: F.when(
        p.startswith(HEAD), F.regexp_extract(p, head, 1))))

    def turn(p: Column, i: Column) -> Column:
        seen = F.filter(F.slice("heads", F.lit(1), i + 1), lambda h: h.isNotNull())
        in_force = F.when(F.size(seen) > 0, unescape(F.element_at(seen, -1))).otherwise(F.col("role"))
        return F.struct(in_force.alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text"))

    return said.select(
        "conv_id", "segment", F.transform("pieces", turn).alias("turns"),
        F.transform("spans", lambda s: unescape(F.substring("body", (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("loss"),
        F.length("body").cast("long").alias("chars"))
