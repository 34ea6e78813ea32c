"""Readers and writers of the engine's files. All paths go through Spark, never through open()."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconstruct import OUTBUILDING
from ..functions.scalars import parse_number, section_code, text_or_null, title_case, zero_fill

# Names of the columns of the source files.
REQUIRED = ("id_mutation", "date_mutation", "valeur_fonciere", "code_commune", "type_local", "surface_reelle_bati")
NUMERIC = (
    "valeur_fonciere", "surface_reelle_bati", "surface_terrain", "nombre_pieces_principales", "nombre_lots", "longitude", "latitude",
    "lot1_surface_carrez", "lot2_surface_carrez", "lot3_surface_carrez", "lot4_surface_carrez", "lot5_surface_carrez",
)
# Texts of the source files and what the model calls them; other texts stay as they are.
PREMISES = {"Appartement": "Apartment", "Maison": "House"}
OUTBUILDING_TEXT = "dépendance"  # in any case
NATURES = {"Vente": "Sale", "Vente en l'état futur d'achèvement": "Off-plan sale"}
LOTS = tuple(f"lot{k}_surface_carrez" for k in range(1, 6))


def separator(spark: SparkSession, path: str) -> str:
    """The most frequent of four separators in the header."""
    header = spark.read.text(path).first()
    line = header[0].lstrip("﻿") if header else ""
    return max(",;\t|", key=line.count)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names trimmed and lower-cased, the first of doubled names kept.

    A gzip file is one task: it is dealt out again behind the scan. `_ord` is the place in the files,
    taken in the scan, so that it is the same on every run and does not change when rows are dealt out.
    """
    sep = separator(spark, path)
    raw = spark.read.option("header", False).option("sep", sep).option("encoding", "UTF-8").csv(path)
    head = raw.first()
    names = [str(x or "").lstrip("﻿").strip().lower() for x in head]
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(names))])
    body = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).csv(path)
    keep = [k for k, n in enumerate(names) if n and names.index(n) == k]
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    out = body.select(*(F.col(f"_c{k}").alias(names[k]) for k in keep), place.alias("_ord"))
    lacking = [c for c in REQUIRED if c not in out.columns]
    if lacking:
        raise ValueError(f"{path}: missing columns {', '.join(lacking)}")
    return out.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else out


def named(x: Column, names: dict[str, str]) -> Column:
    out = x
    for source, name in names.items():
        out = F.when(x == source, name).otherwise(out)
    return out


def typed_lines(raw: DataFrame, communes: DataFrame | None = None) -> DataFrame:
    """The engine's lines from texts: markers become NULL, numbers parse tolerantly, keys are built, values are named.

    Lines without a premise type and, if `communes` is given, of other communes are dropped in the
    scan. `ord` is the order in the file, as `read_lines` found it in `_ord`.
    """
    has = set(raw.columns)
    if "_ord" not in has:
        raise ValueError("lines have no column _ord, their order in the file")
    text = lambda c: text_or_null(F.col(c)) if c in has else F.lit(None).cast("string")
    number = lambda c: parse_number(text(c)) if c in has else F.lit(None).cast("double")
    lines = raw.where(text("type_local").isNotNull()).withColumn("commune", zero_fill(text("code_commune")))
    if communes is not None:
        lines = lines.join(communes.select("commune").distinct(), "commune", "left_semi")
    lots = [number(c) for c in LOTS]
    known = F.coalesce(*lots)
    house = F.regexp_replace(F.coalesce(text("adresse_numero"), F.lit("")), r"\.0$", "")
    address = F.trim(F.regexp_replace(F.concat_ws(" ", house, text("adresse_suffixe"), title_case(text("adresse_nom_voie"))), r"(?U)\s+", " "))
    kind = F.trim(text("type_local"))
    premise = F.when(F.lower(kind) == OUTBUILDING_TEXT, OUTBUILDING).otherwise(named(kind, PREMISES))
    return lines.select(
        text("id_mutation").alias("sale_id"), F.col("_ord").alias("ord"), F.to_date(F.try_to_timestamp(text("date_mutation"))).alias("sale_date"), named(F.trim(text("nature_mutation")), NATURES).alias("nature"),
        number("valeur_fonciere").alias("price"), premise.alias("premise_type"), number("surface_reelle_bati").alias("area"),
        F.when(known.isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in lots), F.lit(0.0))).alias("private_area"), number("nombre_pieces_principales").alias("rooms"),
        text("id_parcelle").alias("parcel"), section_code(text("id_parcelle"), F.col("commune"), text("section_prefixe")).alias("section"), "commune", F.coalesce(text("nom_commune"), F.col("commune")).alias("commune_name"),
        address.alias("address"), kind.rlike(r"(?i)^local\s+industriel").alias("is_activity"), number("longitude").alias("lon"), number("latitude").alias("lat"),
    )


def read_sales(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Frozen sales; columns that the file lacks are skipped."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def write_sales(sales: DataFrame, path: str, counters: dict) -> None:
    """zstd parquet and, beside it, the sorted counters as JSON."""
    sales.write.mode("overwrite").option("compression", "zstd").parquet(path)
    text = json.dumps(counters, sort_keys=True, ensure_ascii=False, allow_nan=False)
    sales.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.trace")


def read_communes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    return raw.select(
        zero_fill(F.trim("code_commune")).alias("commune"), "nom_commune", F.trim("code_departement").alias("department"), F.trim("code_region").alias("region"), "nom_region",
        F.coalesce(F.trim("population").try_cast("long"), F.lit(0)).alias("population"),
    )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a text list: comments and what follows a tab or semicolon are dropped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.trim(F.split(line, "[\t;]")[0]).alias("commune"))


def read_removals(spark: SparkSession, path: str) -> DataFrame:
    """date;commune;address; a line of another form fails the job and is quoted with its number."""
    good = r"^(\d{4}-\d{2}-\d{2});([0-9AB]{5});(.+)$"
    whole = spark.read.text(path, wholetext=True)  # a list is written by hand
    each = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("k", "line")).select((F.col("k") + 1).cast("string").alias("k"), F.trim("line").alias("line"))
    rows = each.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
    checked = F.when(F.col("line").rlike(good), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("malformed removal, line "), "k", F.lit(": "), "line")))
    parts = rows.select(F.split(checked, ";", 3).alias("p"))
    return parts.select(F.col("p")[0].cast("date").alias("removed_date"), F.col("p")[1].alias("removed_commune"), F.trim(F.col("p")[2]).alias("removed_address"))


def commune_identity(properties: Column) -> Column:
    """The commune of three property names, padded; codes of zeros only are none."""
    value = lambda n: F.nullif(F.get_json_object(properties, f"$.{n}"), F.lit(""))
    code = zero_fill(F.coalesce(value("code_commune"), value("commune"), value("id")))
    return F.when(F.trim(code, F.lit("0")) != "", code)


def features(texts: DataFrame, text_col: str, expected: Column | None = None, identity: Callable[[Column], Column] | None = None) -> DataFrame:
    """`texts` with a row (k, zone, geometry) for each usable feature of its collections; Polygon is a MultiPolygon of one part.

    A text that is no collection has no features.
    """
    from ..operators.geo import section_identity

    others = [c for c in texts.columns if c != text_col]
    f = texts.select(*others, F.posexplode(F.from_json(text_col, "features array<string>")["features"]).alias("k", "f"))
    kind, coordinates = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    many = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "MultiPolygon", coordinates)
    nested = F.from_json(many, "array<array<array<array<double>>>>")
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    geometry = F.transform(nested, lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))
    properties = F.get_json_object("f", "$.properties")
    zone = identity(properties) if identity else section_identity(properties, expected=expected)
    return f.select(*others, "k", zone.alias("zone"), geometry.alias("geometry")).where("zone IS NOT NULL AND geometry IS NOT NULL")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(zone, geometry) from feature collections; the first feature of an id wins."""
    rows = features(spark.read.text(path, wholetext=True), "value")
    return rows.groupBy("zone").agg(F.min_by("geometry", "k").alias("geometry"))


def read_commune_contours(spark: SparkSession, path: str) -> DataFrame:
    """(zone, geometry) of communes; the first feature of a code wins, a file that is no collection gives nothing."""
    rows = features(spark.read.text(path, wholetext=True), "value", identity=commune_identity)
    return rows.groupBy("zone").agg(F.min_by("geometry", "k").alias("geometry"))


def write_network(stations: DataFrame, path: str) -> None:
    """Station records as lines of JSON, sorted by name."""
    stations.orderBy("name", "lat", "lon").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Station records, merged again as they are read; lines that are no record are left out."""
    from ..operators.stations import FIELDS, merged

    raw = spark.read.schema(f"{FIELDS}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return merged(raw.where("_bad IS NULL AND name IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").drop("_bad"))


def write_tiles(payloads: DataFrame, path: str) -> None:
    """Tiles as rows (x, y, content) partitioned by x, then the manifest with their sizes and digests."""
    payloads.write.mode("overwrite").partitionBy("x").json(path)
    listed = payloads.select("x", "y", F.octet_length("content").alias("bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
    listed.write.mode("overwrite").json(f"{path}.manifest")


def check_sizes(manifest: DataFrame, most_files: int = 20_000, most_bytes: int = 25 << 20) -> None:
    n, size = manifest.agg(F.count("*"), F.coalesce(F.max("bytes"), F.lit(0))).first()
    if n > most_files or size > most_bytes:
        raise ValueError(f"{n} files, largest {size} bytes")
