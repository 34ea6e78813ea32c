"""Statistics by zone, at one grain or two."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, street_of

METRICS = {
    "median_m2": ("price_m2", F.median),
    "mean_m2": ("price_m2", F.avg),
    "median_price": ("price", F.median),
    "mean_price": ("price", F.avg),
}


def _measures() -> list[Column]:
    return [
        F.count("*").alias("n_sales"),
        F.median("price_m2").alias("median_m2"),
        half_even(F.avg("price_m2")).alias("mean_m2"),
        half_even(F.median("price")).alias("median_price"),
        half_even(F.avg("price")).alias("mean_price"),
        half_even(F.median("area")).alias("median_area"),
    ]


def statistics(sales: DataFrame, key: str) -> DataFrame:
    """One row for each zone; sales without a zone are left out. The median per m2 is not rounded."""
    return sales.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("zone")).agg(*_measures())


def statistics_of_both(sales: DataFrame) -> DataFrame:
    """Sections and communes in one pass, by grouping sets; a sale without a section counts in its commune."""
    section, commune = F.col("section"), F.col("commune")
    measures = [F.count("*").alias("n_sales"), F.median("price_m2").alias("median_m2"), F.rint(F.avg("price")).alias("mean_price")]
    grain = F.when(F.grouping("section") == 0, "section").otherwise("commune").alias("grain")
    out = sales.groupingSets([[section], [commune]], section, commune).agg(grain, *measures)
    return out.select("grain", F.coalesce("section", "commune").alias("zone"), "n_sales", "median_m2", "mean_price").where("zone IS NOT NULL")


def extremes(sales: DataFrame, key: str) -> DataFrame:
    """The dearest and the cheapest sale of each zone, by price, with its attributes.

    Ties go to the earlier sale, then to the first in the file (`ord`, where sales have it), then to the
    smaller id. Sales without a price are passed over; a zone with no other stays, with NULLs.
    """
    whole = {"sale": "sale_id", "price": "price", "area": "area", "m2": "price_m2", "type": "property_type", "date": "sale_date"}
    tie = [c for c in ("ord", "sale_id") if c in sales.columns]
    day = F.to_date("sale_date")
    order = lambda price: F.when(F.col("price").isNotNull(), F.struct(price.alias("by"), day.isNull().alias("undated"), day.alias("day"), *tie))
    out = sales.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("zone")).agg(
        F.min_by(F.struct(*whole.values()), order(-F.col("price"))).alias("max"), F.min_by(F.struct(*whole.values()), order(F.col("price"))).alias("min")
    )
    value = lambda end, name: F.to_date(f"{end}.sale_date") if name == "date" else F.col(f"{end}.{whole[name]}")
    return out.select("zone", *(value(end, name).alias(f"{end}_{name}") for end in ("max", "min") for name in whole))


def by_year(sales: DataFrame, key: str, metric: str = "median_m2") -> DataFrame:
    column, aggregate = METRICS[metric]
    return sales.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("zone"), "year").agg(aggregate(column).alias("value"), F.count("*").alias("n"))


def _most_frequent(rows: DataFrame, group: str, items: list[str], k: int) -> DataFrame:
    counted = rows.groupBy(group, *items).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), *items)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def labels(sales: DataFrame, key: str) -> DataFrame:
    """The most frequent (commune name, section) of each zone; ties in alphabetical order."""
    rows = sales.select(F.col(key).alias("zone"), "commune_name", "section").dropna()
    return _most_frequent(rows, "zone", ["commune_name", "section"], 1).select("zone", F.concat_ws(" ", "commune_name", "section").alias("label"), "n")


def main_streets(sales: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k streets with most sales of each zone, in one text."""
    rows = sales.select(F.col(key).alias("zone"), street_of(F.col("address")).alias("street")).dropna().where(F.length("street") > 2)
    top = _most_frequent(rows, "zone", ["street"], k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "street")))
    return top.groupBy("zone").agg(F.array_join(F.transform(ordered, lambda x: x["street"]), ", ").alias("streets"))


def filter_values(sales: DataFrame) -> DataFrame:
    """What the filters offer: sorted distinct years, types and states."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return sales.agg(joined("year").alias("years"), joined("property_type").alias("types"), joined("state").alias("states"))


def area_ceiling(sales: DataFrame) -> DataFrame:
    return sales.agg((F.floor(F.percentile("area", 0.99) / 50) * 50 + 50).cast("long").alias("ceiling"))


def coverage(sales: DataFrame) -> DataFrame:
    return sales.agg(F.to_date(F.min("sale_date")).alias("first_date"), F.to_date(F.max("sale_date")).alias("last_date"))


def opening_frame(sales: DataFrame, box: tuple[float, float, float, float], least: int = 50) -> DataFrame:
    """Percentiles 1 and 99 of the positions inside the box; the box if they are few or flat."""
    from .filters import in_box

    inside = sales.where(in_box(F.col("lon"), F.col("lat"), box, 0.0))
    q = inside.agg(F.count("*").alias("n"), F.percentile("lon", F.array(F.lit(0.01), F.lit(0.99))).alias("x"), F.percentile("lat", F.array(F.lit(0.01), F.lit(0.99))).alias("y"))
    good = (F.col("n") >= least) & (F.col("x")[0] < F.col("x")[1]) & (F.col("y")[0] < F.col("y")[1])
    edges = (F.col("x")[0], F.col("y")[0], F.col("x")[1], F.col("y")[1])
    return q.select(*(half_even(F.when(good, e).otherwise(F.lit(float(b))), 6).alias(n) for n, e, b in zip(("west", "south", "east", "north"), edges, box)))


def count_by(sales: DataFrame, key: str) -> DataFrame:
    return sales.groupBy(key).agg(F.count("*").alias("n"))
