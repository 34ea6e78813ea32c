"""Robust colour scales with scarce zones greyed, and the layers a map shows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GREY, PRICE_PALETTE, TREND_PALETTE, colour, euro_label, rate_label
from .trend import coloured

SCARCE = 4


def bounds(value: Column) -> tuple[Column, Column, Column]:
    """Aggregates (low, high, empty): percentiles 5 and 95, else extremes, else half a unit around."""
    low, high = F.percentile(value, 0.05), F.percentile(value, 0.95)
    flat = low >= high
    low, high = F.when(flat, F.min(value)).otherwise(low), F.when(flat, F.max(value)).otherwise(high)
    point = low >= high
    return F.coalesce(F.when(point, low - 0.5).otherwise(low), F.lit(0.0)), F.coalesce(F.when(point, low + 0.5).otherwise(high), F.lit(1.0)), F.count(value) == 0


def scale(stats: DataFrame, metric: str = "median_m2", threshold: int = SCARCE) -> DataFrame:
    """One row (low, high, empty) from the zones with enough sales, or from all if none has."""
    value = F.col(metric)
    enough = F.count_if(F.col("n_sales") > threshold) > 0
    rich, every = bounds(F.when(F.col("n_sales") > threshold, value)), bounds(value)
    return stats.agg(*(F.when(enough, a).otherwise(b).alias(n) for n, a, b in zip(("low", "high", "empty"), rich, every)))


def position(value: Column) -> Column:
    ratio = F.when(F.col("high") <= F.col("low"), F.when(value.isNotNull(), F.lit(0.5))).otherwise((value - F.col("low")) / (F.col("high") - F.col("low")))
    return F.when(~F.col("empty"), ratio)


def zone_colours(stats: DataFrame, metric: str = "median_m2", threshold: int = SCARCE) -> DataFrame:
    both = stats.crossJoin(F.broadcast(scale(stats, metric, threshold)))  # the scale is one row
    grey = F.col("n_sales") <= threshold
    return both.withColumn("greyed", grey).withColumn("colour", F.when(grey, GREY).otherwise(colour(position(F.col(metric)), PRICE_PALETTE)))


def ticks(one_scale: DataFrame, n: int = 5) -> DataFrame:
    n = max(n, 2)
    return one_scale.select(F.posexplode(F.array(*(F.col("low") + F.lit(k / (n - 1)) * (F.col("high") - F.col("low")) for k in range(n)))).alias("tick", "value"))


def price_layer(stats: DataFrame, labels: DataFrame, streets: DataFrame, metric: str = "median_m2") -> DataFrame:
    """One row for each zone with what a map shows of it."""
    return zone_colours(stats, metric).join(labels.select("zone", "label"), "zone", "left").join(streets, "zone", "left").select("zone", "label", "streets", "n_sales", F.col(metric).alias("value"), "greyed", "colour")


def trend_layer(stats: DataFrame, trends: DataFrame) -> DataFrame:
    """Rates are blank where they are not reliable, the number of years stays."""
    t = coloured(trends).select("zone", "rate", "r2", "n_years", "reliable", F.col("colour").alias("trend_colour"))
    sure = F.coalesce("reliable", F.lit(False))
    return stats.join(t, "zone", "left").select(
        "zone", "n_sales", F.when(sure, F.col("rate")).alias("rate"), F.when(sure, F.col("r2")).alias("r2"), F.coalesce("n_years", F.lit(0)).alias("n_years"), F.coalesce("trend_colour", F.lit(GREY)).alias("colour")
    )


def price_legend(one_scale: DataFrame, title: str, note: str, n: int = 5) -> DataFrame:
    """(title, palette, ticks, note): one row, ticks as euro labels."""
    n = max(n, 2)
    labels = F.array(*(euro_label(F.col("low") + F.lit(k / (n - 1)) * (F.col("high") - F.col("low")), "") for k in range(n)))
    return one_scale.select(F.lit(title).alias("title"), F.array(*map(F.lit, PRICE_PALETTE)).alias("palette"), labels.alias("ticks"), F.lit(note).alias("note"))


def trend_legend(one_amplitude: DataFrame, title: str, note: str) -> DataFrame:
    """The same for yearly rates from minus to plus the amplitude."""
    a = F.col("amplitude")
    return one_amplitude.select(F.lit(title).alias("title"), F.array(*map(F.lit, TREND_PALETTE)).alias("palette"), F.array(rate_label(-a), rate_label(a * 0), rate_label(a)).alias("ticks"), F.lit(note).alias("note"))


def sales_scale(one_scale: DataFrame, column: str = "price_m2") -> DataFrame:
    """What a map needs to colour sales on the scale of the zones: bounds and palette, no colour for each sale."""
    return one_scale.select("low", "high", "empty", F.array(*map(F.lit, PRICE_PALETTE)).alias("palette"), F.lit("m2" if column == "price_m2" else "va").alias("column"))
