"""Section contours from many GeoJSON files: which file counts for a commune, and where a contour comes from.

Files are indexed by name. A name that holds `section` and the code of a commune belongs to it; of its
files the canonical one (`<root>/<department>/<code>-sections.geojson`) counts first, then the others
under the root in order of folder and name, then the cached one (`<cache>/<code>-sections.geojson`).
The first of them that holds a usable contour is the commune's source, whole and alone: files that are
unreadable or hold none are passed over. Features without an identity or a geometry are left out, and
of a section that two communes' sources hold the first commune's contour counts.

The index reads names only, and contents are read by tasks, a file to a row, for the communes that are
asked for; the driver holds names of files, as Spark's own listing does.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import department_of
from .files import features

CANONICAL, LOCAL, CACHED = 0, 1, 2
# Fixed value: the code of a commune in the name of a file.
CODE_IN_NAME = r"(?<![0-9A-Za-z])(\d[0-9AB]\d{3})(?![0-9])"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def index(spark: SparkSession, root: str, cache: str | None = None) -> DataFrame:
    """(commune, rank, folder, file, path) of every file of contours, by name alone."""
    plain = lambda path: re.sub(_SCHEME, "", path).rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*section*json").load([root, *([cache] if cache else [])]).select("path").distinct()
    parts = found.withColumn("plain", F.regexp_replace("path", _SCHEME, "")).withColumns({"file": F.element_at(F.split("plain", "/"), -1), "folder": F.regexp_replace("plain", "/[^/]*$", "")})
    named = parts.where(F.col("file").rlike(r"\.(geo)?json$")).withColumn("commune", F.regexp_extract("file", CODE_IN_NAME, 1)).where("commune <> ''")
    own = F.concat("commune", F.lit("-sections.geojson"))
    rank = F.when(F.col("plain") == F.concat(F.lit(f"{plain(root)}/"), department_of(F.col("commune")), F.lit("/"), own), CANONICAL)
    rank = rank.when(F.startswith("plain", F.lit(f"{plain(root)}/")), LOCAL)
    rank = rank.when(F.col("plain") == F.concat(F.lit(f"{plain(cache)}/"), own), CACHED) if cache else rank
    return named.select("commune", rank.alias("rank"), "folder", "file", "path").where("rank IS NOT NULL")


@dataclass
class Contours:
    zones: DataFrame  # zone, commune, geometry, source
    sources: DataFrame  # commune, source; NULL where no file holds a contour


def load(spark: SparkSession, root: str, communes: DataFrame, sections: DataFrame | None = None, cache: str | None = None) -> Contours:
    """Contours of the communes in `communes`, of the sections in `sections` if given, and each commune's source."""
    asked = communes.select("commune").where("commune IS NOT NULL").distinct()
    files = index(spark, root, cache).join(asked, "commune", "left_semi")
    paths = [r["path"] for r in files.select("path").distinct().toLocalIterator()]
    if paths:
        texts = spark.read.format("binaryFile").load([p.replace("%", "%25") if "%" in p else p for p in paths]).select("path", F.col("content").cast("string").alias("text"))
    else:
        texts = spark.createDataFrame([], "path string, text string")
    usable = features(files.join(texts, "path"), "text", F.col("commune"))
    order = F.struct("rank", "folder", "file", "path")
    first = usable.groupBy("commune").agg(F.min(order).alias("best")).withColumn("source", F.concat(F.when(F.col("best.rank") == CACHED, "cache").otherwise("local"), F.lit(" ("), F.col("best.file"), F.lit(")")))
    chosen = usable.join(first.select("commune", F.col("best.path").alias("path"), "source"), ["commune", "path"])
    if sections is not None:
        chosen = chosen.join(sections.select(F.col("section").alias("zone")).distinct(), "zone", "left_semi")
    once = chosen.withColumn("n", F.row_number().over(Window.partitionBy("zone").orderBy("commune", "k"))).where("n = 1")
    return Contours(once.select("zone", "commune", "geometry", "source"), asked.join(first.select("commune", "source"), "commune", "left"))


def without_contour(sections: DataFrame, zones: DataFrame) -> DataFrame:
    """Sections that are asked for and have no contour: their sales count and are not drawn."""
    return sections.select("section").where("section IS NOT NULL").distinct().join(zones.select(F.col("zone").alias("section")), "section", "left_anti")
