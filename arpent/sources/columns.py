"""Sales as packed binary columns, sorted by commune and price; a lossy value fails.

`publish_columns` writes them in slices from the tasks, for any number of sales; `encode` gives one
territory's columns as one file.
"""
from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import whole_and_hundredths
from .published import publish, read_published
from .stores import Scratch

VERSION = 1
NO_SECTION = 0xFFFF
DICTIONARIES = {"commune": "commune_id", "section": "section_id", "property_type": "type_id", "state": "state_id"}
NEEDED = ("sale_id", *DICTIONARIES, "year", "price", "area", "price_m2")
VALUES_A_SLICE = 1 << 16
LAYOUT = (("euros", "<u4"), ("section", "<u2"), ("metres", "<u2"), ("year", "u1"), ("type", "u1"), ("state", "u1"), ("cents", "u1"), ("hundredths", "u1"))


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str = "place") -> DataFrame:
    """`rows` sorted by `order`, with `part` and a dense `place` from 0.

    Rows are dealt out by ranges and sorted in their tasks; a task's rows are numbered in it, and the
    numbers of rows of the parts before are added. Only one count for each part reaches the driver.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = scratch.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), inside.alias("in_part")))
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    before = [(part, at) for (part, _), at in zip(sizes, itertools.accumulate((n for _, n in sizes), initial=0))]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn(name, F.col("before") + F.col("in_part")).drop("before", "in_part")


def dictionary(sales: DataFrame, column: str, name: str, scratch: Scratch) -> DataFrame:
    """(column, name): the distinct values with their ranks; nulls have none."""
    return ranked(sales.select(column).where(F.col(column).isNotNull()).distinct(), [column], scratch, name).select(column, name)


def numbered(sales: DataFrame, scratch: Scratch) -> DataFrame:
    """Dictionary ids are ranks of distinct values; both halves of each number are exact.

    The sales are computed and written once, without columns that are not packed; every dictionary reads that table.
    """
    out = once = scratch.written(sales.select(*NEEDED))
    for column, name in DICTIONARIES.items():
        out = out.join(dictionary(once, column, name, scratch), column, "left")
    euros, cents = whole_and_hundredths(F.col("price"))
    metres, hundredths = whole_and_hundredths(F.col("area"))
    return out.withColumns({"euros": euros, "cents": cents, "metres": metres, "hundredths": hundredths, "section_id": F.coalesce("section_id", F.lit(NO_SECTION))})


def _checked(rows: DataFrame) -> tuple[int, int]:
    """(number of rows, first year); raises what does not fit the layout, found by one aggregation."""
    values = _values(F.lit(0))
    parts = [F.count("*").alias("n"), F.min("year").alias("first"), F.count_if(F.col("commune_id").isNull()).alias("homeless")]
    parts += [F.count_if(~F.coalesce(F.rint(F.col("price") / F.col("area")) == F.col("price_m2"), F.lit(False))).alias("wrong")]
    for name, _ in LAYOUT:
        parts += [F.min(values[name]).alias(f"low_{name}"), F.max(values[name]).alias(f"high_{name}"), F.count_if(values[name].isNull()).alias(f"lacks_{name}")]
    r = rows.agg(*parts).first()
    if r["homeless"]:
        raise ValueError("a sale has no commune")
    first = r["first"] or 0
    for name, kind in LAYOUT if r["n"] else ():
        shift = first if name == "year" else 0
        if r[f"lacks_{name}"] or not (0 <= r[f"low_{name}"] - shift and r[f"high_{name}"] - shift <= np.iinfo(kind).max):
            raise ValueError(f"{name} does not fit in {kind}")
    if r["wrong"]:
        raise ValueError("the price per m2 does not follow from price and area")
    return r["n"], first


def _values(first) -> dict[str, Column]:
    found = {"euros": F.col("euros"), "section": F.col("section_id"), "metres": F.col("metres"), "year": F.col("year") - first, "type": F.col("type_id"), "state": F.col("state_id"), "cents": F.col("cents"), "hundredths": F.col("hundredths")}
    return {name: found[name].cast("long") for name, _ in LAYOUT}


def _slices(rows: DataFrame, layout: tuple[tuple[str, str], ...]) -> DataFrame:
    """(prefix, extension, content): for each column and part, the bytes of the part's rows in order of `place`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one part, a few bytes a row
        if not table.num_rows:
            return
        table = table.sort_by("place")
        start = table.column("place")[0].as_py()
        names = [f"{name}-{start:012d}" for name, _ in layout]
        contents = [table.column(name).to_numpy().astype(kind).tobytes() for name, kind in layout]
        yield pa.record_batch({"prefix": names, "extension": ["bin"] * len(names), "content": pa.array(contents, pa.binary())})

    return rows.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(list(pack(iter(t.to_batches())))), "prefix string, extension string, content binary")


def publish_columns(sales: DataFrame, path: str) -> DataFrame:
    """Writes the columns in slices, one for each column and range of rows, and returns the manifest.

    A slice is named by its column and first row, so the slices of a column in order of their names are
    the column. Dictionaries are slices too, a value to a line; `start` has each commune's first row.
    Every task writes its own slices; no column or dictionary is in one place.
    """
    spark = sales.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.written(numbered(sales, scratch))
        n, first = _checked(rows)
        placed = scratch.written(ranked(rows, ["commune", "price_m2", "sale_id"], scratch))
        out = _slices(placed.select("part", "place", *(c.alias(name) for name, c in _values(F.lit(first)).items())), LAYOUT)
        starts = placed.groupBy("commune_id").agg(F.min("place").alias("start")).select(F.col("commune_id").alias("place"), "start", F.floor(F.col("commune_id") / VALUES_A_SLICE).alias("part"))
        out = out.unionByName(_slices(starts, (("start", "<u4"),)))
        for column, name in DICTIONARIES.items():
            values = dictionary(rows, column, name, scratch).withColumn("slice", F.floor(F.col(name) / VALUES_A_SLICE))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, column))), lambda x: x[column]), "\n")
            named = F.concat(F.lit(f"names_{column}-"), F.lpad(F.min(name).cast("string"), 12, "0")).alias("prefix")
            out = out.unionByName(values.groupBy("slice").agg(named, F.lit("txt").alias("extension"), text.cast("binary").alias("content")).drop("slice"))
        return publish(out, path, {"format": VERSION, "n": n, "first_year": first})


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """(place, commune, section, year, property_type, state, price, area, price_m2) of published columns, exact."""
    about = spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).select(F.from_json("value", "format int, n bigint, first_year int").alias("a")).first()["a"]
    if about["format"] != VERSION:
        raise ValueError(f"version {about['format']}")
    kinds = {**dict(LAYOUT), "start": "<u4"}
    files = read_published(spark, path).withColumns({"column": F.substring_index("name", "-", 1), "first": F.split("name", "-")[1].try_cast("long")})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for column, start, content in zip(frame["column"], frame["first"], frame["content"]):
                values = np.frombuffer(content, dtype=kinds[column]).astype(np.int64)
                yield pd.DataFrame({"column": column, "place": start + np.arange(len(values)), "value": values})

    def values_of(column: str) -> DataFrame:
        return files.where(F.col("column") == column).select("column", "first", "content").mapInPandas(unpack, "column string, place long, value long")

    def names_of(column: str, name: str) -> DataFrame:
        lines = files.where(F.col("column") == f"names_{column}").select("first", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("k", column))
        return lines.select((F.col("first") + F.col("k")).alias(name), column)

    long = None
    for name, _ in LAYOUT:
        long = values_of(name) if long is None else long.unionByName(values_of(name))
    wide = long.groupBy("place").agg(*(F.max(F.when(F.col("column") == name, F.col("value"))).alias(name) for name, _ in LAYOUT))
    for column, name, id_name in (("section", "section", "section_id"), ("property_type", "type", "type_id"), ("state", "state", "state_id")):
        wide = wide.withColumnRenamed(name, id_name).join(names_of(column, id_name), id_name, "left")
    starts = values_of("start").select(F.col("place").alias("commune_id"), F.col("value").alias("at")).join(names_of("commune", "commune_id"), "commune_id")
    # each commune's rows begin at its start: marks among the rows, carried on in the slices' own order
    ends = starts.join(starts.select((F.col("commune_id") - 1).alias("commune_id"), F.col("at").alias("until")), "commune_id", "left").withColumn("until", F.coalesce("until", F.lit(about["n"])))
    step = F.lit(VALUES_A_SLICE)
    spread = ends.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / step), F.floor((F.col("until") - 1) / step))))
    wide = wide.withColumn("block", F.floor(F.col("place") / step)).join(spread, "block").where("place >= at AND place < until")
    price, area = (F.col("euros") * 100 + F.col("cents")) / 100, (F.col("metres") * 100 + F.col("hundredths")) / 100
    return wide.select("place", "commune", "section", (F.col("year") + about["first_year"]).alias("year"), "property_type", "state", price.alias("price"), area.alias("area"), F.rint(price / area).alias("price_m2"))


def encode(sales: DataFrame) -> tuple[bytes, str]:
    """The columns of one territory as one file's bytes, a few for each row, and its description as JSON."""
    with Scratch(sales.sparkSession) as scratch:
        rows = scratch.written(numbered(sales, scratch))
        n, first = _checked(rows)
        f: pd.DataFrame = rows.orderBy("commune", "price_m2", "sale_id").select("commune_id", "commune", "section", "property_type", "state", *(c.alias(f"_{name}") for name, c in _values(F.lit(first)).items())).toPandas()
    names = lambda c: sorted(f[c].dropna().unique().tolist())
    starts = np.searchsorted(f["commune_id"].to_numpy(dtype=np.int64), np.arange(len(names("commune")) + 1)).astype("<u4")
    parts = [starts.tobytes(), *(f[f"_{n}"].to_numpy(dtype=kind).tobytes() for n, kind in LAYOUT)]
    meta = {"version": VERSION, "n": n, "first_year": first, "communes": names("commune"), "sections": names("section"), "types": names("property_type"), "states": names("state")}
    return b"".join(parts), json.dumps(meta, sort_keys=True)


def decode(content: bytes, meta: str) -> pd.DataFrame:
    """Rebuilds value, area and price per m2 exactly."""
    m = json.loads(meta)
    if m["version"] != VERSION:
        raise ValueError(f"version {m['version']}")
    n, at = m["n"], 4 * (len(m["communes"]) + 1)
    starts = np.frombuffer(content[:at], dtype="<u4").astype(np.int64)
    out = {}
    for name, kind in LAYOUT:
        size = n * np.dtype(kind).itemsize
        out[name] = np.frombuffer(content[at : at + size], dtype=kind).astype(np.int64)
        at += size
    price, area = (out["euros"] * 100 + out["cents"]) / 100, (out["metres"] * 100 + out["hundredths"]) / 100
    pick = lambda names, k: [names[i] if i < len(names) else None for i in k]
    return pd.DataFrame({
        "commune": np.repeat(m["communes"], np.diff(starts)), "section": pick(m["sections"], out["section"]), "year": out["year"] + m["first_year"],
        "property_type": pick(m["types"], out["type"]), "state": pick(m["states"], out["state"]), "price": price, "area": area, "price_m2": np.rint(price / area),
    })
