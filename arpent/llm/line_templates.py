"""Line deduplication by a log-template tree, in Spark expressions only.

Each line is parsed to a fixed depth: tokens with a digit become the wildcard `<*>`, the first
level is the number of tokens, the next levels are the leading tokens; together they name a leaf.
A leaf holds any number of templates. At each place of a leaf every token has a count of lines. A
line's constants are the tokens that make up the `similarity` share of it by count, the commonest
first (with ties, all of them); its other tokens, rarer at their place than all of these, are fields.
So a field is told by comparing the counts of one line, never by a count alone: a template's constants
are in all its lines and a field's values in a part of them, however common the values get as data
grow. Lines with the same constants at the same places have one template; a line without fields is a
template of its own, as its equals are. A template recurs if `min_docs` different documents or more
hold it. A line whose field happens to hold a token that another template of the leaf makes commoner
than the line's own constants counts with that token as a constant.

Lines of recurring templates are dropped. With `keep_whole` a document that would lose all its lines
stays as it is: such documents are copies, and a later stage keeps one of each group.

Leaves that are too rare to hold a recurring template are counted away first, by one number for each
leaf, so only lines of the other leaves are written and looked into. Equal lines are counted before
their tokens are, so a line that a third of all documents share is one row from each task.

Defined results: null text has no lines and stays null, lines without a token are never dropped and
don't count, rows are told apart by id and text, so repeated rows are one document and lose the same
lines, though each counts where constants are found; an empty table gives an empty table, all other
columns are kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, settled

WILDCARD = "<*>"
_SPACE = r"\x20\x09-\x0D"


def masked(line: Column) -> Column:
    """The line with single spaces between tokens, and the wildcard for tokens with a digit.

    Both patterns match only where something changes, as most lines need neither.
    """
    general = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+", WILDCARD)).otherwise(line)
    return F.btrim(F.regexp_replace(general, rf"[\x09-\x0D]+[{_SPACE}]*+|\x20[{_SPACE}]++", " "))


def _leaf(m: Column, depth: int) -> Column:
    tokens = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(tokens, F.substring_index(m, " ", depth))


def _lines(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """One row (_id, _hash, at, size, m, leaf) for each line with a token."""
    each = docs.select(*row_key("_id_in", text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    found = each.select("_id", "_hash", "at", F.length("line").alias("size"), masked(F.col("line")).alias("m")).where("m <> ''")
    return found.withColumn("leaf", _leaf(F.col("m"), depth))


def _templates(lines: DataFrame, depth: int, similarity: float, min_docs: int) -> DataFrame:
    """(leaf, a, b, template) of the different lines; a and b are hashes of the masked line."""
    counted = lines.groupBy("leaf", "m").agg(F.count("*").alias("n"))
    named = materialise(counted.select("leaf", F.xxhash64("m").alias("a"), F.xxhash64(F.lit("line"), "m").alias("b"), F.split("m", " ").alias("t"), "n"), "lines")
    tokens = named.where(F.size("t") > depth).select("leaf", "a", "b", "n", F.posexplode(F.transform(F.slice("t", depth + 1, F.size("t")), lambda x: F.xxhash64(x))).alias("at", "token"))
    # tokens that fewer lines have are no constants of a template that recurs, fields or not
    common = materialise(tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_docs), "common")
    seen = F.array_sort(F.collect_list(F.struct("at", "token", "lines")))
    wide = named.select("leaf", "a", "b", F.size("t").alias("size")).join(tokens.join(common, ["leaf", "at", "token"]).groupBy("leaf", "a", "b").agg(seen.alias("seen")), ["leaf", "a", "b"], "left")
    needed = F.col("size") - F.floor(F.col("size") * (100 - round(100 * similarity)) / 100).cast("int") - F.least("size", F.lit(depth))
    least = F.when((needed > 0) & (F.size("seen") >= needed), F.element_at(F.sort_array(F.col("seen.lines"), asc=False), needed))
    constants = F.transform(F.filter("seen", lambda x: x["lines"] >= F.col("least")), lambda x: F.struct(x["at"], x["token"]))
    held = wide.withColumn("least", least).withColumn("c", constants)
    fields = F.col("c").isNotNull() & (F.size("c") + F.least("size", F.lit(depth)) < F.col("size"))
    return held.select("leaf", "a", "b", F.when(fields, F.xxhash64(F.lit("fields"), "leaf", "c")).otherwise(F.xxhash64(F.lit("line"), "a", "b")).alias("template"))


@settled("positions")
def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.8, min_docs: int = 10) -> DataFrame:
    """(_id, _hash, positions) for the documents with lines of recurring templates."""
    narrow = docs.select(F.col(id_col).alias("_id_in"), F.col(text_col))
    each = narrow.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).select(masked(F.col("line")).alias("m")).where("m <> ''")
    busy = materialise(each.groupBy(_leaf(F.col("m"), depth).alias("leaf")).count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    lines = materialise(_lines(narrow, text_col, depth).join(busy, "leaf", "left_semi"), "inner")
    named = materialise(_templates(lines, depth, similarity, min_docs), "templates")
    keyed = lines.select("_id", "_hash", "at", "leaf", F.xxhash64("m").alias("a"), F.xxhash64(F.lit("line"), "m").alias("b"))
    placed = materialise(keyed.join(named, ["leaf", "a", "b"]).select("_id", "_hash", "at", "template"), "placed")
    held = placed.select("template", "_id", "_hash").distinct()
    often = materialise(held.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"), "often")
    found = placed.join(often, "template", "left_semi")
    return found.groupBy("_id", "_hash").agg(F.collect_set("at").alias("positions"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_whole: bool = False, counts: bool = True, **options) -> DataFrame:
    """`docs` with `text` reduced; with `counts`, `n_lines`, `n_recurring` and `n_dropped` are added and replace columns of these names."""
    found = dropped_lines(docs, id_col, text_col, **options)
    row = F.struct("*")  # keeps all columns apart from the ones added here
    wide = docs.select(row.alias("row"), *row_key(id_col, text_col)).join(found.hint("merge"), ["_id", "_hash"], "left").select("row", "positions")  # one plan at every size
    text, at = F.col("row")[text_col], F.coalesce("positions", F.array().cast("array<int>"))
    parts, full = F.split(text, "\n"), F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]")))
    drop = (F.size(at) > 0) & (F.size(at) < full) if keep_whole else F.size(at) > 0
    kept = F.array_join(F.filter(parts, lambda x, k: ~F.array_contains(at, k)), "\n")
    reduced = F.when(drop, kept).otherwise(text)
    added = {
        "n_lines": F.when(text.isNull(), 0).otherwise(full).cast("long"),
        "n_recurring": F.size(at).cast("long"),
        "n_dropped": F.when(drop, F.size(at)).otherwise(0).cast("long"),
    } if counts else {}
    kept_columns = ((reduced if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in added)
    return wide.select(*kept_columns, *(c.alias(name) for name, c in added.items()))
