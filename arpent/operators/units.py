"""Communes of an urban unit, from a table whose columns have one of several names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zero_fill

# Names of the columns, first match counts, and the communes that sales know by their districts only.
UNIT_COLUMNS = ("code_unite_urbaine", "code_uu")
COMMUNE_COLUMNS = ("code_commune_insee", "code_insee", "code_commune", "com")
PARENTS = {"75": "75056", "69": "69123", "13": "13055"}


def districts(communes: DataFrame) -> DataFrame:
    """(parent, commune) of the known communes that are districts of a larger one."""
    code = F.col("commune")
    parent = F.coalesce(*(F.when(code.rlike(rf"^{d}1\d\d$"), p) for d, p in PARENTS.items()))
    return communes.select(parent.alias("parent"), code).where("parent IS NOT NULL").distinct()


def _column(table: DataFrame, names: tuple[str, ...]) -> Column:
    by_name = {c.lower(): c for c in reversed(table.columns)}
    found = next((by_name[n] for n in names if n in by_name), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(names)} is in {', '.join(sorted(table.columns)[:12])}")
    return F.col(f"`{found}`")


def in_unit(table: DataFrame, unit: str, known: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(commune) of a unit: parents are replaced by their children first, then only known communes stay.

    `known` has the communes that count, `children` the pairs (parent, commune); a parent without
    children stays a commune. The replacement is a join, so it is the same for any number of levels'
    pairs, and units of any size.
    """
    pairs = districts(known) if children is None else children.select("parent", "commune").distinct()
    code = lambda c: zero_fill(F.trim(c.cast("string")))
    members = table.where(code(_column(table, UNIT_COLUMNS)) == unit).select(code(_column(table, COMMUNE_COLUMNS)).alias("parent")).distinct()
    grown = members.join(pairs, "parent", "left").select(F.coalesce("commune", "parent").alias("commune"))
    return grown.join(known.select("commune").distinct(), "commune", "left_semi").distinct()
