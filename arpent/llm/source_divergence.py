"""Source divergence audit: how far each source's use of words is from the other sources of its language.

Relations only. Terms are the runs of ASCII letters and characters beyond ASCII, with A-Z in lower
case. Each language keeps the terms that at least `min_docs` of its documents hold. Counts of kept
terms are made dense: every group (lang, source), and the language as a whole, has a row for each
kept term, zeros included. Every count becomes a whole share of a thousand million, smoothed by two,
and two shares p and q differ by floor((p - q)^2 / (p + q)). Groups of one language are joined with
each other by term and summed, and a window ranks the sums.

Arithmetic is on whole numbers: decimals where a product would pass 64 bits, so counts may grow to
10^18. Each unordered pair of groups is summed once, as the difference is symmetric.

Spread: documents meet others only as counts, summed in each task before they move, so a source or
a word that most rows hold is one row from each task. Kept terms of a language are dealt to `blocks`
by their hash and its groups are copied to each block, so a language is not one task; the dense
table has groups x kept terms rows, of which a term's rows are as many as its language has sources.
The ten first terms of a group are cut down in each task before they meet.

Defined results: null text, lang or source is ''; texts without a term leave a group with counts of
zero; repeated rows are documents of their own; a language with one source has no pairs; without a
kept term pairs have value 0 and there are no terms; an empty table gives an empty table; other
columns are not read, so their names can't clash. Ties go by item in the order of its UTF-8 bytes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, settled

#: All characters but x00-x40, x5B-x60 and x7B-x7F; Java matches the class as a negation 35 times slower.
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does the same to texts of ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _group(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "source").alias("g")


def _groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """((lang, source, g, l) of each group, seed): hashes stand for names until the end, under the first seed that parts all names."""
    named = materialise(docs.select("lang", "source").distinct(), "names")
    for seed in range(42, 1000):
        hashed = named.withColumns({"g": _group(seed), "l": F.xxhash64(F.lit(seed), "lang")})
        n, n_g, n_lang, n_l = hashed.agg(F.count("*"), F.count_distinct("g"), F.count_distinct("lang"), F.count_distinct("l")).first()
        if (n, n_lang) == (n_g, n_l):
            return hashed, seed
    raise ValueError("no seed parts the groups")


def _counts(docs: DataFrame, seed: int) -> DataFrame:
    """(g, l, term, n, docs): occurrences and documents.

    Behind a document's matches come its different ones, so one explosion gives both counts.
    """
    found = docs.select(_group(seed), F.xxhash64(F.lit(seed), "lang").alias("l"), F.regexp_extract_all(_folded(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    rows = found.select("g", "l", F.size("terms").alias("matches"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    match = F.col("at") < F.col("matches")
    return rows.groupBy("g", "l", "term").agg(F.count_if(match).alias("n"), F.count_if(~match).alias("docs"))


def _share(n: str, total: str, size: str) -> Column:
    wide = f"1 + (1000000000BD * (cast({n} as decimal(19, 0)) + 2)) div (cast({total} as decimal(19, 0)) + 2 * cast({size} as decimal(19, 0)))"
    return F.expr(f"CASE WHEN {n} < 9000000000 THEN 1 + (1000000000L * ({n} + 2)) div ({total} + 2 * {size}) ELSE {wide} END")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


@settled("divergence")
def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, blocks: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the other sources, part `term` the `top` terms."""
    plain = _plain(docs, text_col, lang_col, source_col)
    names, seed = _groups(plain)
    counts = materialise(_counts(plain, seed), "counts")
    kept = counts.groupBy("l", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("l", "term", "n_lang"), "kept")
    held = materialise(counts.join(kept.select("l", "term"), ["l", "term"], "left_semi").select("g", "l", "term", "n"), "held")
    langs = kept.groupBy("l").agg(F.count("*").alias("size"), F.sum("n_lang").alias("lang_total"))
    totals = held.groupBy("g").agg(F.sum("n").alias("total"))
    groups = names.join(totals, "g", "left").join(langs, "l", "left").select("g", "l", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "size", "lang_total")))
    groups = materialise(groups, "groups")

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dense = kept.select("l", "term", "n_lang", block).join(spread, ["l", "block"]).join(held.select("g", "term", "n"), ["g", "term"], "left")
    dense = dense.select("g", "l", "term", F.coalesce("n", F.lit(0)).alias("n"), "n_lang", "total", "size", "lang_total")
    dense = materialise(dense.select("g", "l", "term", "n", _share("n", "total", "size").alias("p"), _share("n_lang", "lang_total", "size").alias("q")), "dense")

    one, two = dense.select("l", "term", "g", "p"), dense.select("l", "term", F.col("g").alias("g2"), F.col("p").alias("q"))
    summed = one.join(two, ["l", "term"]).where("g < g2").groupBy("g", "g2").agg(F.sum(_apart("p", "q")).alias("value"))
    both = summed.unionByName(summed.select(F.col("g2").alias("g"), F.col("g").alias("g2"), "value"))
    others = names.join(names.select("l", F.col("g").alias("g2"), F.col("source").alias("item")), "l").where("g <> g2")
    pairs = others.join(both, ["g", "g2"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    own = dense.where("n > 0 AND p > q").select("g", F.col("term").alias("item"), _apart("p", "q").alias("value")).join(names, "g").select("lang", "source", "item", "value")
    return _ranked(pairs, "pair").unionByName(_ranked(own, "term", top))
