"""Places found by what a visitor types: exact, then at the start, then anywhere in the name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import search_key

EXACT, START, INSIDE = 0, 1, 2
GRAM = 3


def collated(x: Column, locale: str = "fr") -> Column:
    """The text as its language sorts it: letters first, accents and then case only between equal letters."""
    return F.collate(x, locale)


def _grams(key: Column) -> Column:
    """The distinct runs of up to three characters: all of one, two and three."""
    run = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - size + 1, F.lit(1))), lambda k: F.substr(key, k, F.lit(size)))
    return F.filter(F.array_distinct(F.concat(*(run(size) for size in range(1, GRAM + 1)))), lambda g: g != "")


def index(places: DataFrame, name_col: str = "name") -> DataFrame:
    """(gram, key, name): each name under every gram of its key; names are distinct."""
    named = places.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("key", search_key(F.col("name")))
    return named.select(F.explode(_grams(F.col("key"))).alias("gram"), "key", "name")


def find(queries: DataFrame, grams: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(id, name, rank): the best place of each query, in the order of names within a rank; without one, no row.

    A query meets only the names that hold its rarest run of three characters (or itself, if it is
    shorter), so the join's size follows the index's rarest entries, not the number of names.
    """
    asked = queries.select(F.col(id_col), search_key(F.col(text_col)).alias("asked")).where(F.col("asked") != "")
    size = F.least(F.length("asked"), F.lit(GRAM))
    own = F.filter(_grams(F.col("asked")), lambda g: F.length(g) == F.col("size"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    each = asked.withColumn("size", size).select(id_col, "asked", F.explode(own).alias("gram")).join(held, "gram", "left")
    rarest = each.groupBy(id_col, "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select(id_col, "asked", F.col("g.gram").alias("gram"))
    met = rarest.join(grams, "gram").where(F.contains("key", F.col("asked")))
    rank = F.when(F.col("key") == F.col("asked"), EXACT).when(F.startswith("key", F.col("asked")), START).otherwise(INSIDE)
    best = met.groupBy(id_col).agg(F.min(F.struct(rank.alias("rank"), collated(F.col("name")).alias("order"), "name")).alias("b"))
    return best.select(id_col, F.col("b.name").alias("name"), F.col("b.rank").alias("rank"))
