"""The interactive filter as one predicate, perimeters and removals."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import address_key


@dataclass(frozen=True)
class SaleFilter:
    """None or empty: no constraint. `years` is a set of values. `area_max` None: open."""

    years: Sequence[int] | None = None
    area_min: float | None = None
    area_max: float | None = None
    types: Sequence[str] | None = None
    states: Sequence[str] | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        for column, values in (("year", self.years), ("property_type", self.types), ("state", self.states)):
            if values:
                out = out & F.col(column).isin(*values)
        if self.area_min is not None:
            out = out & (F.col("area") >= self.area_min)
        if self.area_max is not None:
            out = out & (F.col("area") <= self.area_max)
        return out

    def apply(self, sales: DataFrame) -> DataFrame:
        return sales.where(self.predicate())


def within(sales: DataFrame, communes: DataFrame) -> DataFrame:
    """Sales of a perimeter. Spark broadcasts the list if its measured size allows it."""
    return sales.join(communes.select("commune").distinct(), "commune", "left_semi")


def without_removed(sales: DataFrame, removed: DataFrame) -> DataFrame:
    """Sales without those withdrawn on request: (removed_date, removed_commune, removed_address)."""
    gone = removed.select(F.date_format("removed_date", "yyyy-MM-dd").alias("d"), F.col("removed_commune").alias("c"), address_key(F.col("removed_address")).alias("a")).distinct()
    on = (F.date_format(sales.sale_date, "yyyy-MM-dd") == gone.d) & (sales.commune == gone.c) & (address_key(sales.address) == gone.a)
    return sales.join(gone, on, "left_anti")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float], margin: float = 0.02) -> Column:
    west, south, east, north = box
    inside = lon.between(west - margin, east + margin) & lat.between(south - margin, north + margin)
    return F.coalesce(inside, F.lit(False))


def search(sales: DataFrame, commune: str, address: str, date: str) -> DataFrame:
    """By commune code or part of its name, part of the address, start of the date; case is folded, the earliest first."""
    found = sales.where((F.col("commune") == commune) | F.contains(address_key(F.col("commune_name")), address_key(F.lit(commune))))
    found = found.where(F.contains(address_key(F.col("address")), address_key(F.lit(address))))
    return found.where(F.startswith(F.date_format("sale_date", "yyyy-MM-dd"), F.lit(date))).orderBy("sale_date")


def removal_lines(found: DataFrame, most: int = 5) -> DataFrame:
    """(line) to add to the list of removals for the sales that a search found; more than `most` fail, as the search was too wide."""
    n = found.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} sales: name the day or the whole address")
    return found.orderBy("sale_date").select(F.concat_ws(";", F.date_format("sale_date", "yyyy-MM-dd"), "commune", "address").alias("line")).distinct()


def default_filters(sales: DataFrame) -> DataFrame:
    """One row (years, low, high, open_ended, types, states): everything passes."""
    listed = lambda c: F.array_sort(F.collect_set(c)).alias
    top = (F.floor(F.percentile("area", 0.99) / 50) * 50 + 50).cast("double")
    return sales.agg(listed("year")("years"), F.lit(0.0).alias("low"), top.alias("high"), F.lit(True).alias("open_ended"), listed("property_type")("types"), listed("state")("states"))
