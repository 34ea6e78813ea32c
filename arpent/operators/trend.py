"""Yearly price trend of each zone: a weighted log-linear fit from grouped sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TREND_PALETTE, colour
from .zones import by_year

# The half-widths that a legend of yearly change may have, in percent.
AMPLITUDES = (2.0, 3.0, 5.0, 8.0, 12.0, 20.0)


def trend(sales: DataFrame, key: str, metric: str = "median_m2", least_sales: int = 5, least_years: int = 3) -> DataFrame:
    """Rate in percent a year, change over the span, R2, and whether the fit is reliable.

    A zone without a usable year is absent; one with too few years is there and not reliable.
    """
    annual = by_year(sales, key, metric).where((F.col("n") >= max(least_sales, 1)) & (F.col("value") > 0))
    # the origin is one number for all zones; the slope doesn't depend on it
    origin = annual.agg(F.min("year").alias("origin"))
    a, y, w = F.col("year") - F.col("origin"), F.ln("value"), F.col("n")
    sums = annual.crossJoin(F.broadcast(origin)).groupBy("zone").agg(
        F.count("*").alias("n_years"), F.sum("n").alias("n_sales"),
        F.sum(w).alias("w"), F.sum(w * a).alias("wa"), F.sum(w * y).alias("wy"),
        F.sum(w * a * a).alias("waa"), F.sum(w * a * y).alias("way"), F.sum(w * y * y).alias("wyy"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("value", "year").alias("first_value"), F.max_by("value", "year").alias("last_value"),
    )
    ma, my = F.col("wa") / F.col("w"), F.col("wy") / F.col("w")
    sums = (
        sums.withColumn("spread", F.col("waa") - F.col("w") * ma * ma)
        .withColumn("cov", F.col("way") - F.col("w") * ma * my)
        .withColumn("var", F.col("wyy") - F.col("w") * my * my)
        .withColumn("span", F.col("last_year") - F.col("first_year"))
    )
    reliable = (F.col("n_years") >= max(least_years, 2)) & (F.col("span") > 0) & (F.col("spread") > 0)
    out = sums.withColumn("reliable", reliable).withColumn("slope", F.when(reliable, F.try_divide("cov", "spread")))
    return out.select(
        "zone", "n_years", "n_sales", "first_year", "last_year", "first_value", "last_value", "reliable",
        (F.expm1("slope") * 100).alias("rate"),
        (F.expm1(F.col("slope") * F.col("span")) * 100).alias("change"),
        F.when(F.col("reliable") & (F.col("var") > 0), 1 - (F.col("var") - F.col("slope") * F.col("cov")) / F.col("var")).alias("r2"),
    )


def amplitude(trends: DataFrame) -> DataFrame:
    """The first half-width that holds nine tenths of the reliable rates."""
    r = F.abs(F.col("rate"))
    q = trends.where("reliable").agg(F.percentile(r, 0.9).alias("q"), F.max(r).alias("m"))
    seen = F.when(F.col("q") > 0, F.col("q")).otherwise(F.col("m"))
    ladder = F.when(seen.isNull() | (seen <= AMPLITUDES[0]), AMPLITUDES[0])
    for step in AMPLITUDES[1:]:
        ladder = ladder.when(seen <= step, step)
    return q.select(ladder.otherwise(AMPLITUDES[-1]).alias("amplitude"))


def trend_colour(rate: Column, amplitude_: Column) -> Column:
    return colour(F.when(amplitude_ > 0, (rate + amplitude_) / (2 * amplitude_)), TREND_PALETTE)


def coloured(trends: DataFrame) -> DataFrame:
    both = trends.crossJoin(F.broadcast(amplitude(trends)))
    return both.withColumn("colour", trend_colour(F.when(F.col("reliable"), F.col("rate")), F.col("amplitude")))
