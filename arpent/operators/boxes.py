"""Boxes (west, south, east, north) that were fetched before: which cover a new one, which are absorbed.

Containment is found through a hierarchy of grids. A box of level L is at most as large as a cell of
that level, 2^L units wide, so it touches four cells of it at most. What contains a box is at least as
large and holds its south-west corner, so the candidates are the boxes of the same and of higher levels
whose cells hold that corner: one equality join on (level, cell), whose keys are few for a box, no
matter how many boxes there are. Equal boxes are one before they meet.

Boxes that lie over each other in one cell of one level without containing each other still meet; the
largest of a cell takes away most of them first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("west", "south", "east", "north")
UNIT = 2.0**-10  # width of a cell of level 0, in degrees
TOP = 19  # level whose cells are 512 degrees wide: no box is larger


def _level(margin: float) -> Column:
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) + 2 * margin
    level = F.ceil(F.log2(F.greatest(size, F.lit(UNIT)) / UNIT)).cast("int")
    return F.least(F.greatest(level, F.lit(0)), F.lit(TOP))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / (UNIT * F.pow(F.lit(2.0), level))).cast("long")


def _as_outer(boxes: DataFrame, margin: float, order: str) -> DataFrame:
    """Each box on the cells of its level that it touches, its sides moved out by `margin`."""
    wide = boxes.select(F.col(order).alias("by"), _level(margin).alias("level"), (F.col("west") - margin).alias("w"), (F.col("south") - margin).alias("s"), (F.col("east") + margin).alias("e"), (F.col("north") + margin).alias("n"))
    along = lambda a, b: F.explode(F.sequence(_cell(F.col(a), F.col("level")), _cell(F.col(b), F.col("level"))))
    return wide.withColumn("cx", along("w", "e")).withColumn("cy", along("s", "n"))


def _contained(inner: DataFrame, outer: DataFrame, margin: float, order: str, later: bool) -> DataFrame:
    """(order, by) of the boxes of `inner` and one that contains each; `later` asks for a later one."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(TOP))).alias("level")
    corner = inner.select("*", levels).where(F.col("level") >= _level(0.0)).withColumns({"cx": _cell(F.col("west"), F.col("level")), "cy": _cell(F.col("south"), F.col("level"))})
    inside = (F.col("w") <= F.col("west")) & (F.col("s") <= F.col("south")) & (F.col("east") <= F.col("e")) & (F.col("north") <= F.col("n"))
    if later:
        inside &= F.col("by") > F.col(order)
    met = corner.join(_as_outer(outer, margin, order), ["level", "cx", "cy"]).where(inside)
    return met.groupBy(order).agg(F.min("by").alias("by"))


def holding(points: DataFrame, boxes: DataFrame, id_col: str) -> DataFrame:
    """(id, box) for each box that a point (lon, lat) lies in, borders included."""
    place = points.select(F.col(id_col), F.col("lon").alias("west"), F.col("lat").alias("south"), F.explode(F.sequence(F.lit(0), F.lit(TOP))).alias("level"))
    cells = place.withColumns({"cx": _cell(F.col("west"), F.col("level")), "cy": _cell(F.col("south"), F.col("level"))})
    met = cells.join(_as_outer(boxes, 0.0, "box"), ["level", "cx", "cy"])
    return met.where(F.col("west").between(F.col("w"), F.col("e")) & F.col("south").between(F.col("s"), F.col("n"))).select(id_col, F.col("by").cast("long").alias("box"))


def covered(asked: DataFrame, fetched: DataFrame, margin: float = 0.01, id_col: str = "box") -> DataFrame:
    """(id, covered): whether a box lies in one that was fetched, widened by `margin`."""
    once = fetched.groupBy(*SIDES).agg(F.min(id_col).alias(id_col))
    found = _contained(asked, once, margin, id_col, False)
    return asked.select(id_col).join(found.select(id_col, F.lit(True).alias("covered")), id_col, "left").select(id_col, F.coalesce("covered", F.lit(False)).alias("covered"))


def absorbed(boxes: DataFrame, order: str = "box") -> DataFrame:
    """The boxes that remain if each, in turn, takes away the earlier ones it contains.

    Containment is transitive, so a box is gone exactly if a later one contains it. Equal boxes leave
    the last one. In each cell the largest box takes its share before the others meet.
    """
    last = boxes.withColumn("k", F.row_number().over(Window.partitionBy(*SIDES).orderBy(F.desc(order)))).where("k = 1").drop("k")
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    cells = _as_outer(last.withColumn("area", area), 0.0, order)
    largest = cells.groupBy("level", "cx", "cy").agg(F.max_by("by", F.struct((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")), "by")).alias(order)).select(order).distinct()
    some = _contained(last, last.join(largest, order, "left_semi"), 0.0, order, True)
    left = last.join(some, order, "left_anti")
    return left.join(_contained(left, left, 0.0, order, True), order, "left_anti").select(*boxes.columns)
