"""Geometry as nested arrays: polygons of rings of points (lon, lat). No UDF but for simplification."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zero_fill

POINT = "struct<lon:double,lat:double>"
GEOMETRY = f"array<array<array<{POINT}>>>"
_DEGREES_PER_METRE = 1.0 / 111_320.0


def _segments(ring: Column) -> Column:
    """(a, b) for each side of a closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_centre(ring: Column) -> Column:
    """(lon, lat, area) by the shoelace formula; NULL below four points or without area."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(t: Column, e: Column) -> Column:
        cross = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
        return F.struct((t["s"] + cross).alias("s"), (t["x"] + (e["a"]["lon"] + e["b"]["lon"]) * cross).alias("x"), (t["y"] + (e["a"]["lat"] + e["b"]["lat"]) * cross).alias("y"))

    def finish(t: Column) -> Column:
        return F.when(F.abs(t["s"]) >= 1e-12, F.struct((t["x"] / (3 * t["s"])).alias("lon"), (t["y"] / (3 * t["s"])).alias("lat"), F.abs(t["s"] / 2).alias("area")))

    return F.when(F.size(ring) >= 4, F.aggregate(_segments(ring), zero, step, finish))


def inside_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting with half-open sides."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return F.coalesce(spans & (lon < at), F.lit(False))

    return F.aggregate(_segments(ring), F.lit(False), lambda s, e: s != crosses(e))


def inside(geometry: Column, lon: Column, lat: Column) -> Column:
    """In the outer ring of any polygon and in none of its holes."""

    def in_polygon(p: Column) -> Column:
        holes = F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))
        return inside_ring(p[0], lon, lat) & ~F.exists(holes, lambda h: inside_ring(h, lon, lat))

    return F.exists(geometry, in_polygon)


def points_of(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def box_of(geometry: Column) -> Column:
    pts = points_of(geometry)
    return F.struct(
        F.array_min(F.transform(pts, lambda p: p["lon"])).alias("west"), F.array_min(F.transform(pts, lambda p: p["lat"])).alias("south"),
        F.array_max(F.transform(pts, lambda p: p["lon"])).alias("east"), F.array_max(F.transform(pts, lambda p: p["lat"])).alias("north"),
    )


def representative_points(zones: DataFrame) -> DataFrame:
    """Centre of the largest outer ring of (zone, geometry), the first of equals, rounded as published."""
    centres = F.filter(F.transform("geometry", lambda p: ring_centre(p[0])), lambda c: c.isNotNull())
    best = F.reduce(centres, F.lit(None).cast("struct<lon:double,lat:double,area:double>"), lambda a, c: F.when(a.isNull() | (c["area"] > a["area"]), c).otherwise(a))
    out = zones.select("zone", best.alias("b")).where("b IS NOT NULL")
    return out.select("zone", (F.rint(F.col("b.lon") * 1e5) / 1e5).alias("lon"), (F.rint(F.col("b.lat") * 1e5) / 1e5).alias("lat"), (F.rint(F.col("b.area") * 1e8) / 1e8).alias("area"))


def short_name(name: Column) -> Column:
    """A commune's name as it fits on a map: the word for a district is dropped."""
    return F.regexp_replace(name, r"(?U)\s+Arrondissement$", "")


def map_labels(contours: DataFrame, names: DataFrame) -> DataFrame:
    """(name, lon, lat, weight) of communes with a contour and a name, the largest first.

    The weight is the area, so that of two labels in one place the larger commune's is kept. `names`:
    (zone, name).
    """
    known = names.groupBy("zone").agg(F.min("name").alias("name"))
    placed = representative_points(contours).join(known, "zone")
    return placed.select(short_name(F.col("name")).alias("name"), "lon", "lat", F.col("area").alias("weight"), "zone").orderBy(F.desc("weight"), "zone").drop("zone")


def anchors_of_parts(parts: DataFrame, whole: str = "commune") -> DataFrame:
    """(whole, lon, lat, area): the area-weighted middle of what the parts (whole, geometry) cover together.

    For communes that have sections and no contour of their own; holes count by the outer ring.
    """
    rings = parts.select(F.col(whole), F.explode(F.transform("geometry", lambda p: ring_centre(p[0]))).alias("c")).where("c IS NOT NULL")
    area = F.sum("c.area")
    return rings.groupBy(whole).agg((F.sum(F.col("c.lon") * F.col("c.area")) / area).alias("lon"), (F.sum(F.col("c.lat") * F.col("c.area")) / area).alias("lat"), area.alias("area"))


def map_contours(zones: DataFrame, metres: float = 8.0) -> DataFrame:
    """(zone, feature): lighter outlines as GeoJSON features that hold the code and nothing else."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    nested = F.transform("geometry", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, pair)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), nested.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone").alias("c")).alias("properties"), geometry.alias("geometry"))
    return simplified(zones.where("zone IS NOT NULL AND zone <> '' AND geometry IS NOT NULL"), metres).select("zone", F.to_json(feature).alias("feature"))


def points_in_zones(points: DataFrame, zones: DataFrame, cell: float = 0.02) -> DataFrame:
    """(point columns, zone) for points in polygons: an equi-join on grid cells, boxes, then rays.

    Both sides are dealt by cell, so no side is compared with all of the other; a polygon is listed
    under each cell that its box touches.
    """
    boxed = zones.withColumn("b", box_of(F.col("geometry")))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    listed = boxed.withColumn("cx", F.explode(span("b.west", "b.east"))).withColumn("cy", F.explode(span("b.south", "b.north")))
    p = points.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    both = p.join(listed, ["cx", "cy"])
    near = F.col("lon").between(F.col("b.west"), F.col("b.east")) & F.col("lat").between(F.col("b.south"), F.col("b.north"))
    return both.where(near).where(inside(F.col("geometry"), F.col("lon"), F.col("lat"))).select(*points.columns, "zone")


def vertex_count(geometry: Column) -> Column:
    return F.size(points_of(geometry))


def section_identity(properties: Column, get=F.get_json_object, expected: Column | None = None) -> Column:
    """The 10-character section of three property schemas: ready codes, register files, and web answers.

    Blank texts count as missing; NULL if the commune or the letters are missing. `expected` is the
    commune where the properties name none.
    """
    value = lambda *names: F.coalesce(*(F.nullif(F.trim(get(properties, f"$.{n}")), F.lit("")) for n in names))
    ready = [F.when(F.length(value(n)) >= 10, F.substring(value(n), 1, 10)) for n in ("code_section", "id")]
    two_parts = F.nullif(F.concat(F.coalesce(value("code_dep"), F.lit("")), F.coalesce(value("code_com"), F.lit(""))), F.lit(""))
    commune = F.coalesce(value("commune", "code_commune", "code_insee"), two_parts, *([] if expected is None else [expected]))
    prefix = F.coalesce(value("prefixe", "com_abs"), F.lit("000"))
    letters = value("code", "section", "section_courte")
    return F.coalesce(*ready, F.concat(zero_fill(commune), zero_fill(prefix, 3), zero_fill(letters, 2)))


def _worst(points: list[tuple[float, float]], a: int, b: int, tolerance: float, squeeze: float) -> int | None:
    """The point between `a` and `b` that is farthest from the line between them, if beyond the tolerance."""
    (ax, ay), (bx, by) = points[a], points[b]
    dx, dy = (bx - ax) * squeeze, by - ay
    norm = dx * dx + dy * dy
    worst, at = tolerance, None
    for k in range(a + 1, b):
        x, y = (points[k][0] - ax) * squeeze, points[k][1] - ay
        t = max(0.0, min(1.0, (x * dx + y * dy) / norm)) if norm else 0.0
        far = math.hypot(x - t * dx, y - t * dy)
        if far > worst:
            worst, at = far, k
    return at


def _keep(points: list[tuple[float, float]], tolerance: float, squeeze: float) -> list[int]:
    """Douglas-Peucker without recursion: the places of the points to keep."""
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        at = _worst(points, a, b, tolerance, squeeze)
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplify_ring(ring: list[tuple[float, float]], tolerance: float, squeeze: float) -> list[tuple[float, float]]:
    """A ring of fewer than four points is no area: then the ring stays as it is.

    A closed ring is split first at the point farthest from its start, which may lie within a side: it is
    dropped again if the line between its neighbours stays within the tolerance without it.
    """
    if len(ring) < 4:
        return ring
    kept = _keep(ring, tolerance, squeeze)
    split = _worst(ring, 0, len(ring) - 1, tolerance, squeeze) if ring[0] == ring[-1] else None
    if split is not None and len(kept) > 4:
        at = kept.index(split)
        if _worst(ring, kept[at - 1], kept[at + 1], tolerance, squeeze) is None:
            del kept[at]
    out = [ring[k] for k in kept]
    if len(out) < 4:
        return ring
    return out if out[0] == out[-1] else [*out, out[0]]


def simplified(zones: DataFrame, metres: float = 8.0) -> DataFrame:
    """(zone, geometry) with lighter outlines; the one step that is sequential within a ring."""

    def run(batches):
        for frame in batches:
            done = []
            for geometry in frame["geometry"]:
                lats = [p["lat"] for polygon in geometry for ring in polygon for p in ring]
                squeeze = max(math.cos(math.radians(sum(lats) / len(lats))), 0.05) if lats else 1.0
                slim = lambda ring: [{"lon": x, "lat": y} for x, y in simplify_ring([(p["lon"], p["lat"]) for p in ring], metres * _DEGREES_PER_METRE, squeeze)]  # noqa: B023, E731
                done.append([[slim(ring) for ring in polygon] for polygon in geometry])
            yield pd.DataFrame({"zone": frame["zone"], "geometry": done})

    return zones.select("zone", "geometry").mapInPandas(run, f"zone string, geometry {GEOMETRY}")
