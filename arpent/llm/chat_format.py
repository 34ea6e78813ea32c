"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; an array aggregation merges
adjacent turns of one role into one struct, a block, whose texts stay apart as parts:

    <turn user>first text<part>second text</turn>
    <turn assistant>answer</turn>

Texts and roles hold no `<` in the output: a backslash becomes two, `<` becomes `\\l`, and in roles
`>` becomes `\\g`. So control strings in a text are plain text again after reading back, and every
`<` of the output begins a marker. The loss mask is a list of spans, in code points of the output,
one for each assistant text.

Defined results: null text and null role count as empty, turns without a number come first, ties
are ordered by role and text, repeated rows are turns of their own, rows without a conversation id
form one conversation, an empty table gives an empty table, other columns are ignored. One
conversation is one row of the output, so its turns meet in one task by definition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    """Reads each backslash with the character behind it."""
    out = text
    for code, char in (("l", "<"), ("g", ">")):
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\" + code, "$1" + char)
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, n_blocks); loss_spans: array of (start, length)."""
    blank = F.lit("")
    entry = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, blank).alias("role"), F.coalesce(text_col, blank).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(entry)).alias("t"))

    block, texts = "struct<role:string,texts:array<string>>", "array<string>"
    nothing = F.struct(F.array().cast(f"array<{block}>").alias("done"), F.lit(None).cast("string").alias("role"), F.array().cast(texts).alias("texts"))
    closed = lambda s: F.when(s["role"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["role"].alias("role"), s["texts"].alias("texts"))))

    def merge(s: Column, x: Column) -> Column:
        text, same = escape(x["text"]), s["role"].eqNullSafe(x["role"])
        more = F.struct(s["done"].alias("done"), x["role"].alias("role"), F.array_append(s["texts"], text).alias("texts"))
        return F.when(same, more).otherwise(F.struct(closed(s).alias("done"), x["role"].alias("role"), F.array(text).alias("texts")))

    blocks = sorted_turns.select("conv_id", F.aggregate("t", nothing, merge, closed).alias("blocks"))
    lead = lambda b: F.concat(F.lit("<turn "), escape(b["role"], role=True), F.lit(">"))
    written = F.transform("blocks", lambda b: F.struct((b["role"] == loss_role).alias("loss"), b["texts"].alias("texts"), F.length(lead(b)).alias("lead"), F.concat(lead(b), F.array_join(b["texts"], "<part>"), F.lit("</turn>\n")).alias("out")))
    written = blocks.select("conv_id", written.alias("b"))

    spans = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def mark(s: Column, text: Column) -> Column:
        span = F.struct(s["at"].alias("start"), F.length(text).alias("length"))
        return F.struct((s["at"] + F.length(text) + F.lit(len("<part>"))).alias("at"), F.array_append(s["spans"], span).alias("spans"))

    def advance(s: Column, b: Column) -> Column:
        inside = F.struct((s["at"] + b["lead"]).alias("at"), s["spans"].alias("spans"))
        found = F.when(b["loss"], F.aggregate(b["texts"], inside, mark, lambda x: x["spans"])).otherwise(s["spans"])
        return F.struct((s["at"] + F.length(b["out"])).alias("at"), found.alias("spans"))

    return written.select(
        "conv_id",
        F.array_join(F.col("b.out"), "").alias("formatted"),
        F.aggregate("b", start, advance, lambda s: s["spans"]).alias("loss_spans"),
        F.size("b").cast("long").alias("n_blocks"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of an output, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, 7, 1 << 30), ">", 1))
        body = F.substr(block, F.locate(">", block) + 1)
        return F.transform(F.split(body, "<part>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
