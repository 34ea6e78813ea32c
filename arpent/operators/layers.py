"""What a map shows of all zones of one grain: rows, legend, a sentence, and the scale for single sales."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GREY, THOUSANDS, rate_label
from . import scale, trend, zones

#: Columns of a layer's figures, in order; those of trends come behind.
FIGURES = ("n_sales", "median_m2", "mean_m2", "median_price", "mean_price", "median_area", "max_price", "min_price")
TREND_FIGURES = ("rate", "change", "r2", "n_years")
LEAST_SALES, LEAST_YEARS = 5, 3  # of a year with a median, and of a trend


@dataclass(frozen=True)
class Words:
    """What a layer says; `noun` is the word for a zone."""

    noun: str = "section"
    metric: str = "Median price"
    scarce: str = "Too few sales to stand for their place"
    no_trend: str = "No trend"


@dataclass
class Layer:
    rows: DataFrame  # zone, colour, title, streets, note, figures
    legend: DataFrame  # title, palette, ticks, note
    summary: DataFrame  # summary: one sentence
    scale: DataFrame  # low, high, empty, palette, column: for single sales, in every mode


def number_or_null(x: Column) -> Column:
    """A number that JSON can hold: NaN and infinite values are NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def whole_label(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(THOUSANDS))


def layer(sales: DataFrame, key: str, metric: str = "median_m2", threshold: int = scale.SCARCE, with_trend: bool = False, words: Words = Words(), streets: DataFrame | None = None, titles: DataFrame | None = None) -> Layer:
    """The complete layer of a grain: prices, or with `with_trend` their yearly change.

    Zones with at most `threshold` sales are grey and say so, as do zones without a reliable trend; of
    those the number of usable years stays, and rate, change and r2 are NULL. `titles` (zone, label) and
    `streets` (zone, streets) belong to the territory and do not change with filters; a zone without a
    title shows its code. `sales` is read several times: hand over a table that is written.
    """
    ends = zones.extremes(sales, key).select("zone", "max_price", "min_price")
    stats = zones.statistics(sales, key).join(ends, "zone", "left")
    one = scale.scale(stats, metric, threshold)
    rows = stats
    if with_trend:
        found = trend.trend(sales, key, metric, LEAST_SALES, LEAST_YEARS)
        coloured = trend.coloured(found).select("zone", "rate", "change", "r2", F.col("n_years").alias("years"), "reliable", F.col("colour").alias("hue"))
        rows = rows.join(coloured, "zone", "left").withColumn("sure", F.coalesce("reliable", F.lit(False)))
        rows = rows.withColumns({c: F.when(F.col("sure"), number_or_null(F.col(c))) for c in ("rate", "change", "r2")})
        rows = rows.withColumns({"n_years": F.col("years"), "colour": F.when(F.col("sure"), F.coalesce("hue", F.lit(GREY))).otherwise(GREY), "note": F.when(~F.col("sure"), f"{words.no_trend}: it takes {LEAST_YEARS} years of {LEAST_SALES} sales")})
        sure = found.where("reliable").agg(F.count("*").alias("sure"), F.median("rate").alias("middle"))
        total = stats.agg(F.count("*").alias("n"))
        text = F.concat(F.col("sure").cast("string"), F.lit(f" of "), F.col("n").cast("string"), F.lit(f" {words.noun}s have {LEAST_YEARS} years of {LEAST_SALES} sales or more; the territory's median is "), rate_label(F.col("middle")), F.lit("."))
        legend = scale.trend_legend(trend.amplitude(found), f"Yearly change of the {words.metric[:1].lower()}{words.metric[1:]}", f"Grey: fewer than {LEAST_YEARS} usable years")
        summary = sure.crossJoin(total).select(text.alias("summary"))  # a row each
    else:
        rows = scale.zone_colours(rows, metric, threshold).withColumn("note", F.when(F.col("greyed"), f"{words.scarce}: {words.noun} in grey"))
        facts = stats.agg(F.coalesce(F.sum("n_sales"), F.lit(0)).alias("sales"), F.count("*").alias("n"), F.count_if(F.col("n_sales") <= threshold).alias("grey"))
        tail = F.when(F.col("grey") > 0, F.concat(F.lit(", "), F.col("grey").cast("string"), F.lit(" of them grey for lack of sales."))).otherwise(".")
        summary = facts.select(F.concat(whole_label(F.col("sales")), F.lit(" sales in "), F.col("n").cast("string"), F.lit(f" {words.noun}s"), tail).alias("summary"))
        legend = scale.price_legend(one, words.metric, f"Grey: fewer than {threshold + 1} sales" if threshold else "Grey: no sale passes the filters")
    rows = rows.join(titles.select("zone", "label"), "zone", "left") if titles is not None else rows.withColumn("label", F.lit(None).cast("string"))
    rows = rows.join(streets.select("zone", "streets"), "zone", "left") if streets is not None else rows.withColumn("streets", F.lit(None).cast("string"))
    figures = FIGURES + (TREND_FIGURES if with_trend else ())
    out = rows.select("zone", "colour", F.coalesce("label", "zone").alias("title"), "streets", "note", *figures)
    return Layer(out, legend, summary, scale.sales_scale(one, "price_m2" if metric.endswith("m2") else "price"))


def navigation_limits(frame: DataFrame, margin: float = 0.6) -> DataFrame:
    """The box (west, south, east, north) that a map does not leave: `frame` widened, half as much in latitude."""
    return frame.select((F.col("west") - margin).alias("west"), (F.col("south") - margin / 2).alias("south"), (F.col("east") + margin).alias("east"), (F.col("north") + margin / 2).alias("north"))
