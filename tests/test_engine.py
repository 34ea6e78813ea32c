import json

import pytest
from pyspark.sql import functions as F

from arpent.functions import scalars as sc
from arpent.operators import zones, geo, quality, reconstruct, stations, tiles, trend, vintage
from arpent.sources import columns, files


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,number", [("12,5", 12.5), (" 1 234.5", 1234.5), ("abc", None), ("1d", None), ("-", None), ("nan", None), ("1e3", 1000.0), ("1\u00a0234", 1234.0)])
def test_parse_number(spark, text, number):
    assert one(spark, text, lambda x: sc.parse_number(sc.text_or_null(x))) == number


@pytest.mark.parametrize("x,y", [(2.5, 2.0), (3.5, 4.0), (-0.5, 0.0)])
def test_half_even(spark, x, y):
    got = one(spark, x, sc.half_even, "double")
    assert got == y and str(got)[0] != "-"


@pytest.mark.parametrize("x,y", [("L'EGLISE", "L'Eglise"), ("12bis", "12Bis"), ("saint-denis", "Saint-Denis")])
def test_title_case(spark, x, y):
    assert one(spark, x, sc.title_case) == y


def test_small_texts(spark):
    assert one(spark, "123456", sc.zero_fill) == "123456"
    assert one(spark, "  Straße   5 ", sc.address_key) == "strasse 5"
    assert one(spark, "12 bis Rue X", sc.street_of) == "Rue X"
    assert one(spark, "97105", sc.department_of) == "971"
    assert one(spark, 0.0, lambda x: sc.colour(x, sc.PRICE_PALETTE), "double") == "#00695c"
    assert one(spark, None, lambda x: sc.colour(x, sc.PRICE_PALETTE), "double") == sc.GREY


LINE = "sale_id string, ord long, sale_date date, nature string, price double, premise_type string, area double, private_area double, rooms double, parcel string, section string, commune string, commune_name string, address string, is_activity boolean, lon double, lat double"


def line(**k):
    base = dict(sale_id="a", ord=0, sale_date="2022-01-01", nature="Sale", price=300000.0, premise_type="Apartment", area=50.0, private_area=None, rooms=2.0, parcel="75001000AB0001", section="75001000AB", commune="75001", commune_name="P", address="1 Rue X", is_activity=False, lon=2.0, lat=48.0)
    return {**base, **k}


def lines(spark, *rows):
    plain = LINE.replace("sale_date date", "sale_date string")
    return spark.createDataFrame([[r[f.split()[0]] for f in plain.split(", ")] for r in rows], plain).withColumn("sale_date", F.col("sale_date").cast("date"))


def test_reconstruction(spark):
    rows = [line(), line(ord=1), line(ord=2, premise_type="Outbuilding", area=None), line(sale_id="b", ord=3), line(sale_id="b", ord=4, area=70.0, section="75001000AC", address="2 Rue Y"), line(sale_id="c", ord=5, premise_type="Outbuilding")]
    got = {r["sale_id"]: r for r in reconstruct.reconstruct(lines(spark, *rows)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["price"], got["a"]["area"], got["a"]["n_repeats"], got["a"]["n_outbuildings"]) == (300000.0, 50.0, 1, 1)
    assert (got["b"]["area"], got["b"]["n_premises"], got["b"]["section"], got["b"]["address"]) == (120.0, 2, "75001000AC", "2 Rue Y")


def test_ties_go_to_the_smaller_section_and_unknown_areas_lose(spark):
    rows = [line(section="75001000AC"), line(ord=1, section="75001000AB", parcel="p2"), line(sale_id="b", ord=2, area=None, section="75001000AA"), line(sale_id="b", ord=3, section="75001000AZ", parcel="p3")]
    got = {r["sale_id"]: r["section"] for r in reconstruct.reconstruct(lines(spark, *rows)).collect()}
    assert got == {"a": "75001000AB", "b": "75001000AZ"}


def test_quality_charges_the_first_broken_rule(spark):
    rows = [line(sale_id="ok"), line(sale_id="cheap", price=1.0), line(sale_id="none", price=None), line(sale_id="swap", nature="Exchange", price=None), line(sale_id="high", price=2e7), line(sale_id="fill", area=None, private_area=60.0)]
    sales = reconstruct.reconstruct(lines(spark, *rows))
    assert {r["rule"]: r["n"] for r in quality.rejects(sales).collect()} == {"price too low": 1, "no price": 1, "nature": 1, "price per m2 too high": 1}
    kept = {r["sale_id"]: r for r in quality.survivors(sales).collect()}
    assert set(kept) == {"ok", "fill"} and kept["fill"]["area"] == 60.0 and kept["fill"]["price_m2"] == 5000.0
    assert quality.report(sales).first()["n_fallback"] == 1


def test_trend_of_ten_percent(spark):
    rows = [("AB", 2021 + y, 5000.0 * 1.1**y) for y in range(4) for _ in range(6)] + [("AC", 2021, 4000.0)] * 5
    t = trend.trend(spark.createDataFrame(rows, "section string, year int, price_m2 double"), "section")
    got = {r["zone"]: r for r in t.collect()}
    assert got["AB"]["rate"] == pytest.approx(10.0) and got["AB"]["change"] == pytest.approx(33.1) and got["AB"]["r2"] == pytest.approx(1.0)
    assert got["AC"]["reliable"] is False and got["AC"]["rate"] is None


def test_point_in_holed_square(spark):
    p = lambda pts: [{"lon": float(x), "lat": float(y)} for x, y in pts]
    square = lambda a, s: p([(a, a), (a + s, a), (a + s, a + s), (a, a + s), (a, a)])
    zones = spark.createDataFrame([("z", [[square(0, 4), square(1, 1)]])], f"zone string, geometry {geo.GEOMETRY}")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0)], "id int, lon double, lat double")
    assert [r["id"] for r in geo.points_in_zones(points, zones, 1.0).collect()] == [1]
    assert geo.representative_points(zones).first()[1:] == (2.0, 2.0, 16.0)


def test_simplification_keeps_corners():
    ring = [(0, 0), (0.5, 0.0000001), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert geo.simplify_ring(ring, 1e-4, 1.0) == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert geo.simplify_ring(ring[:3], 1e-4, 1.0) == ring[:3]


STATION = "name string, lon double, lat double, network string, type string, status string, lines array<string>, planned array<string>, ord long"


def test_stations_merge_and_reconcile(spark):
    rows = [("Gare X", 2.0, 48.0, "RER", "station", "service", ["RER A"], [], 1), ("GARE X", 2.0005, 48.0, "Metro", "subway", "works", ["Line 15"], None, 2), ("Gare X", 2.1, 48.0, "RER", "station", "service", ["RER B"], [], 3)]
    got = sorted((r["lines"], r["planned"]) for r in stations.merged(spark.createDataFrame(rows, STATION)).collect())
    assert got == [(["RER A"], ["Line 15"]), (["RER B"], [])]
    near = [("Open", 2.0, 48.0, "RER", "station", "service", ["E"], [], 1), ("Other", 2.001, 48.0, "RER", "station", "works", ["E", "F"], None, 2), ("Far", 2.004, 48.0, "RER", "station", "works", ["E"], None, 3)]
    once = stations.reconciled(spark.createDataFrame(near, STATION))
    assert sorted((r["name"], r["lines"]) for r in once.collect()) == [("Far", ["E"]), ("Open", ["E"]), ("Other", ["F"])]
    assert stations.reconciled(once).count() == 3


def test_binary_columns_give_values_back(spark):
    rows = [(1, "00001", "00001AA", "House", "Old", 300000.5, 50.25, 5970.0, 2020), (2, "00002", None, "House", "New", 200000.0, 40.0, 5000.0, 2021)]
    sales = spark.createDataFrame(rows, "sale_id int, commune string, section string, property_type string, state string, price double, area double, price_m2 double, year int")
    back = columns.decode(*columns.encode(sales))
    assert back[["price", "area", "price_m2", "year"]].values.tolist() == [[300000.5, 50.25, 5970.0, 2020], [200000.0, 40.0, 5000.0, 2021]]
    with pytest.raises(Exception, match="decimals"):
        columns.encode(sales.withColumn("price", F.lit(1.001)))


def test_lines_from_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("ID_mutation;date_mutation;nature_mutation;valeur_fonciere;adresse_numero;adresse_nom_voie;code_commune;id_parcelle;type_local;surface_reelle_bati\n1;2022-03-04;Vente;300 000,50;12.0;RUE DE L'EGLISE;1001;01001000AB0001;Maison;60\n2;2022-03-04;Vente;1;1;X;1001;01001000AB0001;;60\n", encoding="utf-8-sig")
    got = files.typed_lines(files.read_lines(spark, str(path))).collect()
    assert len(got) == 1
    assert (got[0]["price"], got[0]["area"], got[0]["commune"], got[0]["section"], got[0]["address"]) == (300000.5, 60.0, "01001", "01001000AB", "12 Rue De L'Eglise")


def test_removal_list_fails_on_a_bad_line(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("# note\n2022-01-01;75001;1 Rue X\n")
    assert files.read_removals(spark, str(path)).count() == 1
    path.write_text("2022-01-01;75001\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_removals(spark, str(path)).collect()


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    path = tmp_path / "z.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"code_section": "75001000AB"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"commune": "75002", "prefixe": "000", "code": "C"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}, indent=1))  # over several lines
    got = {r["zone"]: len(r["geometry"]) for r in files.read_geojson(spark, str(path)).collect()}
    assert got == {"75001000AB": 1, "750020000C": 2}


def test_tile_content(spark):
    rows = [(1, 2.1, 48.8, 2020, 3, 50.0, 300000.0, 6000.0, "House", "Old", "a"), (2, 2.1, 48.8, 2021, None, 40.0, 200000.0, 5000.0, "House", "New", "b")]
    sales = spark.createDataFrame(rows, "sale_id int, lon double, lat double, year int, rooms int, area double, price double, price_m2 double, property_type string, state string, address string").withColumn("sale_date", F.lit("2020-05-06").cast("date"))
    got = json.loads(tiles.payloads(tiles.placed(sales, (2.0, 48.0, 3.0, 49.0))).first()["content"])
    assert got["off"] == [0, 2] and got["pi"] == [3, -1] and got["dt"] == [20200506, 20200506] and got["ty"] == [0, 0] and got["ad_l"] == ["a", "b"]


def test_sources_compared(spark):
    old, new = (spark.createDataFrame(x, "name string, digest string") for x in ([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]))
    assert {r["name"]: r["reason"] for r in vintage.source_changes(old, new).collect()} == {"a": "revised", "b": "removed", "c": "added"}


def test_section_identity_of_three_schemas(spark):
    from arpent.operators.geo import section_identity

    cases = [
        ('{"code_section": " 75101000AB9 "}', "75101000AB"),
        ('{"code_section": "", "id": "75101000AC"}', "75101000AC"),
        ('{"id": "7", "commune": "1001", "prefixe": "12", "code": "B"}', "010010120B"),
        ('{"code_dep": "93", "code_com": "051", "com_abs": "", "section": "AD"}', "93051000AD"),
        ('{"code_insee": "93051", "section_courte": "ABC"}', "93051000ABC"),
        ('{"commune": "93051"}', None),
        ('{"code": "AB"}', None),
    ]
    rows = spark.createDataFrame([(p,) for p, _ in cases], "p string").select(section_identity(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in rows] == [want for _, want in cases]


_STATION = "name string, lon double, lat double, network string, type string, status string, lines array<string>, planned array<string>, ord long"


def test_stations_fold_into_one_place(spark):
    rows = [
        ("Gare du Nord", 2.3550, 48.88, "Métro", "subway", "service", ["Métro 4"], None, 0),
        ("gare du nord", 2.3551, 48.88, "Metro; RER", "station", "service", ["RER B", "metro 4 "], ["Ligne 15"], 1),
        ("Gare du Nord", 2.3552, 48.88, "Tram", "tram", "project", ["ligne 15", "Tram 9"], None, 2),
        ("Gare du Nord", 2.50, 48.88, "Eurostar", "station", "works", ["X"], None, 3),
    ]
    out = sorted(stations.merged(spark.createDataFrame(rows, _STATION)).collect(), key=lambda r: r["lon"])
    assert len(out) == 2 and out[1]["status"] == "works" and list(out[1]["lines"]) == ["X"]
    one = out[0]
    assert one["network"] == "Metro;RER" and one["status"] == "service" and one["lon"] == 2.3551
    assert list(one["lines"]) == ["RER B", "metro 4"] and list(one["planned"]) == ["Ligne 15", "Tram 9"]


def test_a_stop_without_a_name_opens_no_line(spark):
    rows = [
        ("Cité", 2.3000, 48.88, "Tram", "tram", "project", ["Tram 9"], [], 0),
        ("--", 2.3040, 48.88, "Tram", "tram", "service", ["tram 9"], [], 1),
    ]
    out = stations.reconciled(spark.createDataFrame(rows, _STATION)).collect()
    assert sorted(r["name"] for r in out) == ["--", "Cité"]
    near = stations.reconciled(spark.createDataFrame([rows[0], ("Cité Nord", *rows[1][1:])], _STATION)).collect()
    assert [r["name"] for r in near] == ["Cité Nord"]


def test_a_sale_without_section_counts_in_its_commune(spark):
    sales = spark.createDataFrame([("A1", "A", 10.0, 100.0, 10.0), (None, "A", 30.0, 300.0, 10.0)], "section string, commune string, price_m2 double, price double, area double")
    got = {(r["grain"], r["zone"]): r["n_sales"] for r in zones.statistics_of_both(sales).collect()}
    assert got == {("section", "A1"): 1, ("commune", "A"): 2}
