"""Individual sales as map tiles: rows for each location, offsets and dictionaries for each tile."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_number, half_even, tile_x, tile_y, whole_or_sentinel
from .filters import in_box
from .reconstruct import MIXED

ZOOM = 14


def placed(sales: DataFrame, box: tuple[float, float, float, float], zoom: int = ZOOM) -> DataFrame:
    """Sales with a position inside the box; positions are rounded before the tile is found."""
    kept = sales.where(in_box(F.col("lon"), F.col("lat"), box)).withColumn("lon", half_even(F.col("lon"), 5)).withColumn("lat", half_even(F.col("lat"), 5))
    return kept.withColumn("x", tile_x(F.col("lon"), zoom)).withColumn("y", tile_y(F.col("lat"), zoom))


def locations(points: DataFrame) -> DataFrame:
    """One row for each location of a tile: sales, median price per m2, and the icon's type."""
    types = F.array_sort(F.collect_set("property_type"))
    return points.groupBy("x", "y", "lon", "lat").agg(F.count("*").alias("n"), F.median("price_m2").alias("median_m2"), F.when(F.size(types) == 1, types[0]).otherwise(MIXED).alias("icon"))


def offsets(points: DataFrame) -> DataFrame:
    """For each location the index of its first sale within the tile."""
    counted = points.groupBy("x", "y", "lon", "lat").agg(F.count("*").alias("n"))
    w = Window.partitionBy("x", "y").orderBy("lon", "lat")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("k", F.row_number().over(w)).withColumn("offset", F.coalesce(before, F.lit(0)))


def dictionary(points: DataFrame, column: str) -> DataFrame:
    """Local ids of a tile's distinct texts."""
    distinct = points.select("x", "y", F.col(column).alias("text")).distinct()
    return distinct.withColumn("id", F.dense_rank().over(Window.partitionBy("x", "y").orderBy("text")) - 1)


def location_sales(points: DataFrame, lon: float, lat: float) -> DataFrame:
    """The sales of one location, newest first."""
    return points.where((F.col("lon") == lon) & (F.col("lat") == lat)).orderBy(F.desc("sale_date"), "sale_id")


def in_view(points: DataFrame, x0: int, y0: int, x1: int, y1: int, most: int = 24) -> DataFrame:
    """Tiles of a viewport, or none if it spans too many."""
    if (x1 - x0 + 1) * (y1 - y0 + 1) > most:
        return points.limit(0)
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def payloads(points: DataFrame) -> DataFrame:
    """(x, y, content): a tile as JSON of parallel columns; a tile is bounded by its few streets."""
    row = F.struct(
        "lon", "lat", F.col("year").alias("an"), whole_or_sentinel(F.col("rooms")).alias("pi"), whole_or_sentinel(F.col("area")).alias("su"), whole_or_sentinel(F.col("price")).alias("va"),
        whole_or_sentinel(F.col("price_m2")).alias("m2"), date_number(F.col("sale_date")).alias("dt"), F.col("property_type").alias("ty"), F.col("state").alias("et"), F.col("address").alias("ad"), "sale_id",
    )
    tiles = points.groupBy("x", "y").agg(F.array_sort(F.collect_list(row)).alias("r"))
    first = lambda x, k: (k == 0) | (F.get(F.col("r"), k - 1)["lon"] != x["lon"]) | (F.get(F.col("r"), k - 1)["lat"] != x["lat"])
    starts = F.filter(F.transform("r", lambda x, k: F.when(first(x, k), k)), lambda k: k.isNotNull())
    tiles = tiles.withColumn("off", F.concat(starts, F.array(F.size("r"))))
    column = lambda c: F.transform("r", lambda x: x[c])
    text = lambda c: F.transform("r", lambda x: F.coalesce(x[c], F.lit("")))
    for name in ("ty", "et", "ad"):
        tiles = tiles.withColumn(f"{name}_l", F.array_sort(F.array_distinct(text(name))))
    spot = lambda c: F.transform(F.slice("off", 1, F.size("off") - 1), lambda k: F.get(F.col("r"), k)[c])
    coded = lambda c: F.transform("r", lambda x: F.array_position(F.col(f"{c}_l"), F.coalesce(x[c], F.lit(""))) - 1)
    plain = [column(n).alias(n) for n in ("an", "pi", "su", "va", "m2", "dt")]
    ids = [coded(n).alias(n) for n in ("ty", "et", "ad")]
    return tiles.select("x", "y", F.to_json(F.struct(spot("lon").alias("lon"), spot("lat").alias("lat"), "off", *plain, *ids, "ty_l", "et_l", "ad_l")).alias("content"))


def opened(contents: DataFrame) -> DataFrame:
    """The sales of (x, y, content): each with its place, figures and texts, as a map reads them."""
    kinds = "lon array<double>, lat array<double>, off array<int>, " + ", ".join(f"{c} array<bigint>" for c in ("an", "pi", "su", "va", "m2", "dt", "ty", "et", "ad")) + ", ty_l array<string>, et_l array<string>, ad_l array<string>"
    t = contents.select("x", "y", F.from_json("content", kinds).alias("t"))
    place = F.transform("t.off", lambda o, k: F.struct(o.alias("start"), F.get(F.col("t.off"), k + 1).alias("end"), F.get(F.col("t.lon"), k).alias("lon"), F.get(F.col("t.lat"), k).alias("lat")))
    spots = t.select("x", "y", "t", F.explode(F.filter(place, lambda p: p["end"].isNotNull())).alias("p"))
    sales = spots.select("x", "y", "t", "p", F.explode(F.sequence(F.col("p.start"), F.col("p.end") - 1)).alias("k"))
    number = lambda c: F.get(F.col(f"t.{c}"), F.col("k"))
    text = lambda c: F.get(F.col(f"t.{c}_l"), number(c).cast("int")).alias(c)
    return sales.select("x", "y", "p.lon", "p.lat", *(number(c).alias(c) for c in ("an", "pi", "su", "va", "m2", "dt")), text("ty"), text("et"), text("ad"))
