"""Raw lines to one row for each sale, in one shuffle on the sale.

Lines have: sale_id, ord (order in the file), sale_date, nature, price (the same on each line of a
sale), premise_type, area, private_area, rooms, parcel, section, commune, commune_name, address,
is_activity, lon, lat. Missing numbers are NULL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DWELLINGS = ("Apartment", "House")
OUTBUILDING = "Outbuilding"
MIXED = "Mixed"
PREMISE_KEY = ["sale_id", "parcel", "premise_type", "area", "rooms"]


def number_repeats(lines: DataFrame) -> DataFrame:
    """`repeat` counts the lines of one premise in file order; nulls are equal."""
    return lines.withColumn("repeat", F.row_number().over(Window.partitionBy(*PREMISE_KEY).orderBy("ord")))


def drop_repeats(lines: DataFrame) -> DataFrame:
    """Dwelling lines, the first of each premise."""
    return number_repeats(lines.where(F.col("premise_type").isin(*DWELLINGS))).where("repeat = 1").drop("repeat")


def main_section(premises: DataFrame) -> DataFrame:
    """The section with the largest area; ties go to the smaller code, unknown areas come last."""
    by = premises.groupBy("sale_id", "section").agg(F.sum("area").alias("section_area"))
    w = Window.partitionBy("sale_id").orderBy(F.col("section_area").desc_nulls_last(), F.col("section").asc_nulls_last())
    return by.withColumn("k", F.row_number().over(w)).where("k = 1").select("sale_id", F.col("section").alias("main_section"))


def main_line(premises: DataFrame) -> DataFrame:
    """Address, parcel and commune of the largest premise; ties go to the first line."""
    w = Window.partitionBy("sale_id").orderBy(F.col("area").desc_nulls_last(), "ord")
    top = premises.withColumn("k", F.row_number().over(w)).where("k = 1")
    return top.select("sale_id", F.col("address").alias("main_address"), F.col("parcel").alias("main_parcel"))


def price_of_sale(lines: DataFrame) -> DataFrame:
    """Over all lines: the price once, what else the sale holds, and whether prices disagree."""
    return lines.groupBy("sale_id").agg(
        F.max("price").alias("price"),
        F.count_distinct("price").alias("n_prices"),
        F.bool_or("is_activity").alias("has_activity"),
        F.count_if(F.col("premise_type") == OUTBUILDING).alias("n_outbuildings"),
    )


def reconstruct(lines: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row for each sale with a dwelling.

    The window that drops repeats partitions within the sale; the aggregation then needs the same
    distribution, so lines are exchanged on the sale alone: `repartition` names the key once and
    every later step reuses it.
    """
    spread = lines.repartition("sale_id")
    dwelling = F.col("premise_type").isin(*DWELLINGS)
    numbered = number_repeats(spread).withColumn("kept", dwelling & ((F.col("repeat") == 1) | F.lit(not dedupe)))
    kept = F.col("kept")
    by_section = Window.partitionBy("sale_id", "section")
    numbered = numbered.withColumn("section_area", F.sum(F.when(kept, F.col("area"))).over(by_section))

    def first_known(c: str):
        return F.min_by(c, F.when(kept & F.col(c).isNotNull(), F.col("ord"))).alias(c)

    # ranks as structs: a null sorts first, so unknown areas lose against every known one
    section_rank = F.when(kept, F.struct(F.col("section_area").isNull(), -F.coalesce("section_area", F.lit(0.0)), F.col("section").isNull(), F.col("section")))
    line_rank = F.when(kept, F.struct(F.col("area").isNull(), -F.coalesce("area", F.lit(0.0)), F.col("ord")))
    out = numbered.groupBy("sale_id").agg(
        F.max("price").alias("price"),
        F.size(F.collect_set("price")).cast("long").alias("n_prices"),
        F.bool_or("is_activity").alias("has_activity"),
        F.count_if(F.col("premise_type") == OUTBUILDING).alias("n_outbuildings"),
        F.min(F.when(kept, F.col("sale_date"))).alias("sale_date"),
        F.min(F.when(kept, F.col("ord"))).alias("ord"),
        first_known("nature"),
        first_known("commune"),
        first_known("commune_name"),
        F.sum(F.when(kept, F.col("area"))).alias("area"),
        F.sum(F.when(kept, F.col("private_area"))).alias("private_area"),
        F.coalesce(F.sum(F.when(kept, F.col("rooms"))), F.lit(0)).cast("long").alias("rooms"),
        F.count_if(kept).alias("n_premises"),
        F.count_if(dwelling & ~kept).alias("n_repeats"),
        F.array_sort(F.collect_set(F.when(kept, F.col("premise_type")))).alias("types"),
        F.avg(F.when(kept, F.col("lon"))).alias("lon"),
        F.avg(F.when(kept, F.col("lat"))).alias("lat"),
        F.min_by("section", section_rank).alias("section"),
        F.min_by(F.struct("address", "parcel"), line_rank).alias("main"),
    )
    out = out.where("n_premises > 0")
    types = F.col("types")
    return out.select(
        "sale_id", "sale_date", F.year("sale_date").alias("year"), "nature", "price", "n_prices", "commune", "commune_name", "section",
        F.col("main.address").alias("address"), F.col("main.parcel").alias("parcel"),
        F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("private_area", F.lit(0.0)).alias("private_area"), "rooms", "n_premises", "n_repeats", "n_outbuildings", "has_activity",
        F.array_join(types, ", ").alias("premise_types"),
        F.when(F.size(types) == 1, types[0]).otherwise(MIXED).alias("property_type"),
        "lon", "lat", "ord",
    )
