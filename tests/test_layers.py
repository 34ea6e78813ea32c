"""Complete layers, search, labels and network files against plain versions."""
import json
import math

import pytest
from pyspark.sql import functions as F

from arpent.functions import scalars as sc
from arpent.operators import filters, geo, layers, search, stations, zones
from arpent.sources import columns, files, published, stores

SALE = "sale_id string, ord long, sale_date string, year int, section string, commune string, commune_name string, address string, property_type string, price double, area double, price_m2 double"


def sales(spark, *rows):
    base = dict(sale_id="a", ord=0, sale_date="2022-01-01", year=2022, section="S1", commune="C1", commune_name="Ville", address="1 Rue X", property_type="House", price=100000.0, area=50.0, price_m2=2000.0)
    full = [{**base, **r, "ord": k, "sale_id": f"s{k}"} for k, r in enumerate(rows)]
    return spark.createDataFrame([[r[f.split()[0]] for f in SALE.split(", ")] for r in full], SALE).withColumn("sale_date", F.col("sale_date").cast("date"))


def test_price_layer_tells_scarce_zones(spark):
    rows = [dict(section="S1", price_m2=1000.0 + k, price=10000.0 * k) for k in range(1, 7)] + [dict(section="S2", price_m2=9000.0), dict(section=None)]
    s = sales(spark, *rows)
    got = layers.layer(s, "section", titles=zones.labels(s, "section"), streets=zones.main_streets(s, "section"))
    found = {r["zone"]: r for r in got.rows.collect()}
    assert found["S1"]["note"] is None and found["S1"]["title"] == "Ville S1" and found["S1"]["streets"] == "Rue X"
    assert (found["S1"]["n_sales"], found["S1"]["max_price"], found["S1"]["min_price"]) == (6, 60000.0, 10000.0)
    assert found["S2"]["colour"] == sc.GREY and "section in grey" in found["S2"]["note"]
    assert got.summary.first()[0] == "7 sales in 2 sections, 1 of them grey for lack of sales."
    assert got.legend.first()["note"] == "Grey: fewer than 5 sales" and len(got.legend.first()["ticks"]) == 5
    assert layers.layer(s, "section", threshold=0).summary.first()[0] == "7 sales in 2 sections."
    assert layers.layer(s, "section").rows.where("zone = 'S2'").first()["title"] == "S2"


def test_trend_layer_keeps_the_years_and_the_price_scale(spark):
    rows = [dict(section="S1", year=2018 + y, price_m2=1000.0 * 1.1**y) for y in range(4) for _ in range(5)] + [dict(section="S2", year=2018 + y) for y in range(2) for _ in range(5)] + [dict(section="S3")]
    got = layers.layer(sales(spark, *rows), "section", with_trend=True)
    found = {r["zone"]: r for r in got.rows.collect()}
    assert found["S1"]["rate"] == pytest.approx(10) and found["S1"]["note"] is None and found["S1"]["n_years"] == 4
    assert (found["S2"]["rate"], found["S2"]["r2"], found["S2"]["n_years"], found["S2"]["colour"]) == (None, None, 2, sc.GREY) and found["S2"]["note"].startswith("No trend")
    assert found["S3"]["n_years"] is None and found["S3"]["note"].startswith("No trend")
    assert got.summary.first()[0] == "1 of 3 sections have 3 years of 5 sales or more; the territory's median is +10,0 %/an."
    assert got.legend.first()["title"] == "Yearly change of the median price" and got.scale.first()["column"] == "m2" and not got.scale.first()["empty"]
    none = layers.layer(sales(spark, dict()), "section", with_trend=True)
    assert none.summary.first()[0].startswith("0 of 1 sections") and "n/d" in none.summary.first()[0]


def test_json_numbers(spark):
    frame = spark.createDataFrame([(1.5,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in frame.select(layers.number_or_null(F.col("x"))).collect()] == [1.5, None, None, None, None]


NAMES = ["Étampes", "Saint-Maur-des-Fossés", "Saint-Maur", "Eaubonne", "évry", "Évry", "Evry", "Sainte-Marie", "Paris 1er", "Le Saint", "Zut", "L'Haÿ-les-Roses"]


def test_names_in_the_order_of_the_language(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in NAMES], "name string").orderBy(search.collated(F.col("name"))).collect()]
    assert got == ["Eaubonne", "Étampes", "Evry", "évry", "Évry", "L'Haÿ-les-Roses", "Le Saint", "Paris 1er", "Saint-Maur", "Saint-Maur-des-Fossés", "Sainte-Marie", "Zut"]


def test_search_ranks_exact_start_inside(spark):
    grams = search.index(spark.createDataFrame([(n,) for n in [*NAMES, "Zut", None, "''"]], "name string"))
    asked = {"st maur": ("Saint-Maur", 0), "ST MAUR DES": ("Saint-Maur-des-Fossés", 1), "evry": ("Evry", 0), "roses": ("L'Haÿ-les-Roses", 2), "saint": ("Saint-Maur", 1), "e": ("Eaubonne", 1), "1": ("Paris 1er", 2), "ste": ("Sainte-Marie", 1), "m": ("Étampes", 2), "maure": None, "  ": None, "?": None}
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "query_id int, text string")
    got = {r["query_id"]: (r["name"], r["rank"]) for r in search.find(queries, grams).collect()}
    assert {t: got.get(k) for k, t in enumerate(asked)} == asked


def _ring(x, y, w, h):
    return [dict(lon=float(a), lat=float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def test_labels_stand_on_the_largest_part(spark):
    rows = [("00001", [[_ring(0, 0, 1, 1)], [_ring(5, 5, 2, 2)]]), ("00002", [[_ring(0, 0, 1, 1)], [_ring(8, 8, 1, 1)]]), ("00003", [[_ring(0, 0, 9, 9)]]), ("00004", [[_ring(0, 0, 0, 0)]])]
    contours = spark.createDataFrame(rows, f"zone string, geometry {geo.GEOMETRY}")
    names = spark.createDataFrame([("00001", "Paris 11e  Arrondissement"), ("00002", "Arrondissement"), ("00004", "Flat"), ("00009", "No contour")], "zone string, name string")
    got = [tuple(r) for r in geo.map_labels(contours, names).collect()]
    assert got == [("Paris 11e", 6.0, 6.0, 4.0), ("Arrondissement", 0.5, 0.5, 1.0)]
    anchors = {r["commune"]: (r["lon"], r["lat"], r["area"]) for r in geo.anchors_of_parts(contours.withColumnRenamed("zone", "commune")).collect()}
    assert anchors["00001"] == pytest.approx((4.9, 4.9, 5.0)) and "00004" not in anchors


def test_commune_contours_of_three_schemas(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    properties = [{"code_commune": "1001", "id": "9"}, {"commune": "75101"}, {"id": "2A004"}, {"id": "0"}, {"id": ""}, {}, {"code_commune": "", "commune": "7"}, {"commune": "75101"}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": square} for p in properties]}, indent=2))
    (tmp_path / "d.geojson").write_text("{broken")
    got = files.read_commune_contours(spark, f"file://{tmp_path}/*.geojson")
    assert sorted(r["zone"] for r in got.collect()) == ["00007", "01001", "2A004", "75101"]
    feature = json.loads(geo.map_contours(got).where("zone = '75101'").first()["feature"])
    assert feature["properties"] == {"c": "75101"} and feature["geometry"]["coordinates"][0][0][0] == [0.0, 0.0]


def test_network_file_is_merged_as_it_is_read(spark, tmp_path):
    rows = [("B", 2.0, 48.0, "Metro", "station", "service", ["1"], None, 1), ("A", 2.1, 48.0, "RER", "station", "service", ["A"], ["B"], 2), ("a", 2.1001, 48.0, "Metro", "station", "project", ["9"], [], 3)]
    files.write_network(spark.createDataFrame(rows, stations.FIELDS), f"file://{tmp_path}/n")
    part = next(p for p in (tmp_path / "n").iterdir() if p.name.startswith("part"))
    (tmp_path / "n" / "part-99999.json").write_text('{"name": "C", broken\n{"name": "D"}\n' + part.read_text())
    got = {r["name"]: (r["lines"], r["planned"]) for r in files.read_network(spark, f"file://{tmp_path}/n").collect()}
    assert got == {"A": (["A"], ["B", "9"]), "B": (["1"], [])}
    point = json.loads(stations.as_points(files.read_network(spark, f"file://{tmp_path}/n")).where("name = 'A'").first()["feature"])
    assert point["properties"] == {"name": "A", "network": "RER;Metro", "lines": "A", "planned": "B, 9", "status": "service", "rank": 2, "kind": "train"} or point["properties"]["planned"] == "B, 9"
    assert point["geometry"] == {"type": "Point", "coordinates": [2.1, 48.0]}


def test_only_stations_for_passengers(spark):
    rows = [("a", "station", "service", None), ("b", "BUS", "service", None), ("c", "station", "service", "industrial"), (None, "station", "project", None), (None, "station", "service", None), ("", "x", "works", "main")]
    got = stations.for_passengers(spark.createDataFrame(rows, "name string, type string, status string, usage string")).collect()
    assert [(r["name"], r["status"]) for r in got] == [("a", "service"), (None, "service")]


def test_removals_are_capped(spark):
    s = sales(spark, *(dict(address=f"{k} Rue X", sale_date=f"2022-01-0{k}") for k in range(1, 5)))
    found = filters.search(s, "VILLE", "rue  x", "2022-01")
    assert [r["line"] for r in filters.removal_lines(found.where("sale_date > '2022-01-02'")).orderBy("line").collect()] == ["2022-01-03;C1;3 Rue X", "2022-01-04;C1;4 Rue X"]
    with pytest.raises(ValueError, match="over 3 sales"):
        filters.removal_lines(found, 3)


def test_columns_in_slices_are_the_columns_of_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(columns, "VALUES_A_SLICE", 7)
    rows = [(f"s{k}", f"0000{k % 4}", None if k % 5 == 0 else f"S{k % 9}", "House" if k % 3 else "Mixed", "Old", 1000.5 * (k + 1), 10.25 + k % 6, float(round(1000.5 * (k + 1) / (10.25 + k % 6))), 2015 + k % 7) for k in range(100)]
    frame = spark.createDataFrame(rows, "sale_id string, commune string, section string, property_type string, state string, price double, area double, price_m2 double, year int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    manifest = columns.publish_columns(frame, f"file://{tmp_path}/c")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    content, meta = columns.encode(frame)
    files_ = {r["name"]: bytes(r["content"]) for r in published.read_published(spark, f"file://{tmp_path}/c").collect()}
    joined = lambda c: b"".join(files_[n] for n in sorted(files_) if n.startswith(f"{c}-"))
    assert b"".join(joined(c) for c, _ in columns.LAYOUT) == content[4 * 5 :]
    assert joined("start") == content[: 4 * 4] and manifest.where("prefix LIKE 'euros%'").count() > 1
    got = columns.read_columns(spark, f"file://{tmp_path}/c").orderBy("place").toPandas()
    want = columns.decode(content, meta)
    for c in ("commune", "year", "property_type", "state", "price", "area", "price_m2"):
        assert got[c].tolist() == want[c].tolist(), c
    assert [x or None for x in got["section"]] == [x or None for x in want["section"]]
    assert columns.read_columns(spark, f"file://{tmp_path}/c").count() == 100
    for broken, what in ((frame.withColumn("commune", F.lit(None).cast("string")), "commune"), (frame.withColumn("price_m2", F.lit(1.0)), "follow"), (frame.withColumn("year", F.col("year") * F.col("year")), "year")):
        with pytest.raises(ValueError, match=what):
            columns.publish_columns(broken, f"file://{tmp_path}/x")


def test_ranks_are_dense_over_parts(spark):
    with stores.Scratch(spark) as scratch:
        got = columns.ranked(spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v")), ["v"], scratch, "r").collect()
    assert all(r["v"] == r["r"] for r in got)


def test_report_of_a_refresh(spark):
    from arpent.operators import vintage

    old = sales(spark, *[dict(commune="A", commune_name="Aa", year=2020, sale_date="2020-05-01")] * 1200, *[dict(commune="B", commune_name="Bb", year=2021, sale_date="2021-05-01", price_m2=3000.0)] * 5).withColumn("department", F.substring("commune", 1, 1))
    new = sales(spark, *[dict(commune="A", commune_name="Aa", year=2020, sale_date="2020-05-01", section="S9")] * 600, *[dict(commune="C", commune_name="Cc", year=2022, sale_date="2022-05-01")] * 5).withColumn("department", F.substring("commune", 1, 1))
    text = vintage.markdown(old, new, spark.createDataFrame([("S1",)], "section string"), "a new file")
    for line in ("Reason: a new file.", "| all | 1 205 | 605 | -49.8 % |", "| 2020 | 1 200 | 600 | -50.0 % |", "| 2021 | 5 | — | gone |", "| 2022 | — | 5 | new |", "| B | 3 000 | — | gone |", "C (Cc)", "B (Bb)", "1 sections, 600 sales: S9 (600)", "- total: all (1 205 to 605)"):
        assert line in text, (line, text)
    assert "None: the refresh may go ahead." in vintage.markdown(old, old)
