"""Ordered quality rules: each sale is charged to the first rule that it breaks, in one scan."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from .reconstruct import MIXED

OFF_PLAN = "Off-plan sale"
NEW, OLD = "New", "Old"


@dataclass(frozen=True)
class Cleaning:
    """Bounds of the rules; the defaults are fixed values of the model."""

    natures: Sequence[str] | None = ("Sale", OFF_PLAN)
    price_m2_min: float = 500.0
    price_m2_max: float = 30_000.0
    price_min: float = 1_000.0
    area_min: float = 8.0
    drop_with_activity: bool = True
    drop_blocks: bool = True
    block_size: int = 3
    drop_mixed: bool = True


def with_area_fallback(sales: DataFrame) -> DataFrame:
    """The private area stands in where the built area is unknown or zero."""
    lacks = (F.col("area").isNull() | (F.col("area") <= 0)) & (F.col("private_area") > 0)
    return sales.withColumn("area_fallback", F.coalesce(lacks, F.lit(False))).withColumn("area", F.when(F.col("area_fallback"), F.col("private_area")).otherwise(F.col("area")))


def first_broken_rule(o: Cleaning) -> Column:
    """Name of the first rule that a sale breaks; NULL for survivors. Bounds hold before rounding."""
    area, price = F.col("area"), F.col("price")
    m2 = F.try_divide(price, area)
    rules: list[tuple[str, Column]] = []
    if o.natures is not None:
        rules.append(("nature", ~F.coalesce(F.col("nature").isin(*o.natures), F.lit(False))))
    rules += [
        ("no date", F.col("sale_date").isNull()),
        ("no price", price.isNull()),
        ("price not positive", price <= 0),
        ("price too low", price < o.price_min),
        ("no area", area.isNull() | (area <= 0)),
        ("area too small", area < o.area_min),
        ("no section", F.col("section").isNull()),
    ]
    if o.drop_with_activity:
        rules.append(("activity premises", F.col("has_activity")))
    if o.drop_blocks:
        rules.append(("block sale", F.col("n_premises") >= o.block_size))
    if o.drop_mixed:
        rules.append(("mixed types", F.col("property_type") == MIXED))
    rules += [("price per m2 too low", m2 < o.price_m2_min), ("price per m2 too high", m2 > o.price_m2_max)]
    out = F.when(rules[0][1], rules[0][0])
    for name, broken in rules[1:]:
        out = out.when(broken, name)
    return out


def judged(sales: DataFrame, options: Cleaning = Cleaning()) -> DataFrame:
    return with_area_fallback(sales).withColumn("rule", first_broken_rule(options))


def rejects(sales: DataFrame, options: Cleaning = Cleaning()) -> DataFrame:
    """(rule, n) for the rules that removed something."""
    return judged(sales, options).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


def survivors(sales: DataFrame, options: Cleaning = Cleaning()) -> DataFrame:
    """Clean sales with price per m2 and state; texts are never NULL, numbers may be."""
    kept = judged(sales, options).where("rule IS NULL").drop("rule")
    texts = [f.name for f in kept.schema.fields if f.dataType.simpleString() == "string" and f.name != "section"]
    return (
        kept.withColumn("price_m2", half_even(F.try_divide("price", "area")))
        .withColumn("state", F.when(F.col("nature") == OFF_PLAN, NEW).otherwise(OLD))
        .fillna("", texts)
    )


def report(sales: DataFrame, options: Cleaning = Cleaning()) -> DataFrame:
    """One row of counters from one scan."""
    j = judged(sales, options)
    return j.agg(
        F.count("*").alias("n_sales"),
        F.count_if(F.col("rule").isNull()).alias("n_kept"),
        F.count_if("area_fallback").alias("n_fallback"),
        F.coalesce(F.sum("n_repeats"), F.lit(0)).alias("n_repeats"),
        F.count_if(F.col("n_prices") > 1).alias("n_price_conflicts"),
        F.coalesce(F.try_divide(F.count_if(F.col("rule").isNull()), F.count("*")), F.lit(0.0)).alias("kept_ratio"),
    )
