"""Boxes, urban units, contours of several files, and stations refreshed box by box, against plain versions."""
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from arpent.operators import boxes, stations, units
from arpent.sources import contours

BOX = "box long, west double, south double, east double, north double"


def _absorbed(rows):
    kept = []
    for box in rows:
        kept = [k for k in kept if not (box[1] <= k[1] and box[2] <= k[2] and k[3] <= box[3] and k[4] <= box[4])] + [box]
    return sorted(k[0] for k in kept)


def _random_boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = 2.0 ** -rng.randint(-4, 9)
        w, s = rng.choice([-180.0, -0.5, 0.0, 2.25]) + rng.randint(0, 8) * size / 4, rng.choice([-90.0, 48.0, 48.5]) + rng.randint(0, 8) * size / 4
        out.append((k, w, s, w + size * rng.choice([0, 1, 1.5]), s + size))
        if rng.random() < 0.2:
            out[-1] = (k, *rng.choice(out)[1:])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_absorbed_boxes(spark, seed):
    rows = _random_boxes(seed, 150)
    frame = spark.createDataFrame(rows, BOX)
    assert sorted(r["box"] for r in boxes.absorbed(frame).collect()) == _absorbed(rows)
    assert boxes.absorbed(frame.where("false")).count() == 0


@pytest.mark.parametrize("margin", [0.0, 0.01, 0.3])
def test_covered_boxes(spark, margin):
    asked, fetched = _random_boxes(7, 80), _random_boxes(8, 80)
    want = {a[0]: any(f[1] - margin <= a[1] and f[2] - margin <= a[2] and a[3] <= f[3] + margin and a[4] <= f[4] + margin for f in fetched) for a in asked}
    got = boxes.covered(spark.createDataFrame(asked, BOX), spark.createDataFrame(fetched, BOX), margin)
    assert {r["box"]: r["covered"] for r in got.collect()} == want and len(set(want.values())) == 2


def test_points_in_boxes(spark):
    rng, rows = random.Random(1), _random_boxes(9, 60)
    points = [(k, rng.choice(rows)[1 + 2 * (k % 2)], rng.choice(rows)[2] + rng.choice([0, 0.1])) for k in range(100)]
    got = boxes.holding(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(rows, BOX), "id")
    want = {(i, b[0]) for i, x, y in points for b in rows if b[1] <= x <= b[3] and b[2] <= y <= b[4]}
    assert {tuple(r) for r in got.collect()} == want and want


def test_units_by_districts(spark):
    known = spark.createDataFrame([(c,) for c in ("75101", "75120", "13201", "92001", "69123", "00007")], "commune string")
    table = spark.createDataFrame([("x", " 00851 ", "75056"), ("x", "851", "92001"), ("x", "851", "92002"), ("x", "00851", "69123"), ("x", "00851", "7"), ("x", "00100", "13055"), ("x", None, "1"), ("x", "851", None)], "a string, CODE_UU string, Code_Commune string")
    got = units.in_unit(table, "00851", known)
    assert sorted(r["commune"] for r in got.collect()) == ["00007", "69123", "75101", "75120", "92001"]
    assert [r["commune"] for r in units.in_unit(table, "00100", known).collect()] == []
    first = table.withColumn("com", F.lit("92001")).withColumn("code_commune_insee", F.lit("75056"))
    assert sorted(r["commune"] for r in units.in_unit(first, "00851", known).collect()) == ["75101", "75120"]
    with pytest.raises(ValueError, match="none of the columns"):
        units.in_unit(table.drop("CODE_UU"), "00851", known)


def _collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]})


def _square(x):
    return {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 0]]]}


def test_contours_come_from_the_first_usable_file(spark, tmp_path):
    root, cache = tmp_path / "geo 1", tmp_path / "cache"
    for f, text in {
        root / "75" / "75101-sections.geojson": "{broken",
        root / "z" / "cadastre-75101-sections.json": _collection(({"commune": "75101", "code": "B"}, _square(9))),
        root / "a" / "b" / "x-sections-75101.geojson": _collection(({"code": "AB"}, _square(1)), ({"code": "AB"}, _square(2)), ({}, _square(3)), ({"code": "C"}, None)),
        root / "75" / "75102-sections.geojson": _collection(({"id": "751020000D", "x": 1}, _square(4)), ({"code_section": "751010000E"}, _square(5))),
        cache / "75102-sections.geojson": _collection(({"id": "751020000F"}, _square(6))),
        cache / "75103-sections.geojson": _collection(({"code_dep": "75", "code_com": "103", "com_abs": "7", "section": "G"}, {"type": "MultiPolygon", "coordinates": [_square(7)["coordinates"]]})),
        cache / "sub" / "75104-sections.geojson": _collection(({"code": "H"}, _square(8))),
        root / "97" / "97105-sections.geojson": _collection(({"code": "I"}, _square(0))),
        root / "971" / "97105-sections.geojson": "[]",
        root / "75" / "175105-sections.geojson": _collection(({"code": "K"}, _square(0))),
        root / "75" / "75106.geojson": _collection(({"code": "L"}, _square(0))),
    }.items():
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    asked = spark.createDataFrame([(f"7510{k}",) for k in range(1, 7)] + [("97105",), (None,), ("75101",)], "commune string")
    found = contours.load(spark, f"file://{root}", asked, None, f"file://{cache}")
    assert {(r["zone"], r["geometry"][0][0][0]["lon"], r["source"]) for r in found.zones.collect()} == {
        ("75101000AB", 1.0, "local (x-sections-75101.geojson)"), ("751020000D", 4.0, "local (75102-sections.geojson)"), ("751010000E", 5.0, "local (75102-sections.geojson)"),
        ("751030070G", 7.0, "cache (75103-sections.geojson)"), ("971050000I", 0.0, "local (97105-sections.geojson)"),
    }
    assert {r["commune"] for r in found.sources.where("source IS NULL").collect()} == {"75104", "75105", "75106"}
    sections = spark.createDataFrame([("75101000AB",), ("75101000ZZ",), (None,)], "section string")
    some = contours.load(spark, f"file://{root}", asked, sections, f"file://{cache}")
    assert [r["zone"] for r in some.zones.collect()] == ["75101000AB"]
    assert [r["section"] for r in contours.without_contour(sections, some.zones).collect()] == ["75101000ZZ"]
    assert contours.load(spark, f"file://{root}", asked.where("false")).zones.count() == 0


def _station(name, lon, lat, status="service", lines=(), planned=(), k=0, network="Metro"):
    return (name, lon, lat, network, "station", status, list(lines), list(planned), k)


BOXES = f"{BOX}, answered boolean, plans_answered boolean"


def _refresh(spark, known, fresh, rows):
    return stations.refresh(spark.createDataFrame(known, stations.FIELDS), spark.createDataFrame([(*r, b) for b, r in fresh], f"{stations.FIELDS}, box long"), spark.createDataFrame(rows, BOXES))


def test_refresh_replaces_whole_answers_only(spark):
    known = [_station(f"a{k}", 0.1 * k, 0.5, k=k) for k in range(10)] + [_station(f"b{k}", 2 + 0.05 * k, 0.5, k=20 + k) for k in range(10)] + [_station("out", 9.0, 9.0, k=50, planned=["X"])]
    fresh = [(0, _station(f"a{k}", 0.1 * k, 0.5, k=k, lines=["1"])) for k in range(1, 10)] + [(0, _station("a new", 0.2, 0.9, k=99)), (1, _station("b0", 2.0, 0.5))]
    got = _refresh(spark, known, fresh, [(0, 0.0, 0.0, 1.0, 1.0, True, True), (1, 2.0, 0.0, 3.0, 1.0, True, True), (2, 8.0, 8.0, 9.5, 9.5, False, True)])
    assert [tuple(r) for r in got.decisions.orderBy("box").collect()] == [(0, 10, 10, True), (1, 10, 1, False), (2, 1, 0, False)]
    assert sorted(r["name"] for r in got.network.collect()) == sorted([f"a{k}" for k in range(1, 10)] + ["a new", "out"] + [f"b{k}" for k in range(10)])
    assert {tuple(r) for r in got.changes.collect()} == {("appeared", "a new"), ("disappeared", "a0")}


def test_refresh_keeps_plans_without_an_answer_for_them(spark):
    known = [_station("p", 0.5, 0.5, "project", ["L1"]), _station("q", 0.6, 0.6, planned=["L2", "L3"], k=1), _station("r", 0.7, 0.7, k=2)]
    fresh = [(0, _station("q", 0.6, 0.6, lines=["L3"])), (0, _station("r", 0.7, 0.7))]
    rows = [(0, 0.0, 0.0, 1.0, 1.0, True, False)]
    got = _refresh(spark, known, fresh, rows)
    assert {(r["name"], r["status"], tuple(r["lines"]), tuple(r["planned"])) for r in got.network.collect()} == {("p", "project", ("L1",), ()), ("q", "service", ("L3",), ("L2",)), ("r", "service", (), ())}
    assert {tuple(r) for r in got.changes.collect()} == {("opened", "q — L3")}
    answered = _refresh(spark, known, fresh + [(0, _station("s", 0.2, 0.2, "works", ["L9"]))], [(0, 0.0, 0.0, 1.0, 1.0, True, True)])
    assert {tuple(r) for r in answered.changes.collect()} == {("opened", "p — L1"), ("opened", "q — L2"), ("opened", "q — L3"), ("announced", "s — L9")}


def test_refresh_of_overlapping_boxes_in_turn(spark):
    """What a box takes in is replaced by a later box that holds it; counts follow the network of the moment."""
    known = [_station(f"k{k}", 0.5 + k / 100, 0.5, k=k) for k in range(4)]
    fresh = [(0, _station(f"f{k}", 0.5 + k / 100, 0.5, k=k)) for k in range(8)] + [(1, _station(f"g{k}", 0.5 + k / 100, 0.5, k=k)) for k in range(7)] + [(2, _station(f"h{k}", 0.9, 0.5 + k / 100, k=k)) for k in range(7)]
    rows = [(0, 0.0, 0.0, 1.0, 1.0, True, True), (1, 0.4, 0.4, 0.7, 0.7, True, True), (2, 0.3, 0.3, 0.95, 0.95, True, True)]
    got = _refresh(spark, known, fresh, rows)
    assert [tuple(r) for r in got.decisions.orderBy("box").collect()] == [(0, 4, 8, True), (1, 8, 7, False), (2, 8, 7, False)]
    rows[1] = (1, 0.4, 0.4, 0.565, 0.7, True, True)
    got = _refresh(spark, known, fresh, rows)
    assert [tuple(r) for r in got.decisions.orderBy("box").collect()] == [(0, 4, 8, True), (1, 7, 7, True), (2, 8, 7, False)]
    assert sorted(r["name"] for r in got.network.collect()) == sorted([f"g{k}" for k in range(7)] + ["f7"])


@pytest.mark.parametrize("lat", [-70.0, 0.0, 48.85, 54.9, 60.0, 80.0])
def test_nearest_at_any_latitude(spark, lat):
    rng = random.Random(5)
    wide = 0.03 / math.cos(math.radians(lat))
    points = [(k, 10 + rng.uniform(-wide, wide), lat + rng.uniform(-0.03, 0.03)) for k in range(150)]
    held = [(f"s{k}", 10 + rng.uniform(-2 * wide, 2 * wide), lat + rng.uniform(-0.05, 0.05), k) for k in range(25)] + [("none", None, 1.0, 0)]

    def metres(p, s):
        return math.hypot((p[1] - s[1]) * 111_195 * math.cos(math.radians((p[2] + s[2]) / 2)), (p[2] - s[2]) * 111_195)

    frame = spark.createDataFrame(held, "station string, lon double, lat double, n long")
    for where, some in ((None, held[:-1]), (F.col("n") % 3 == 0, held[:-1:3])):
        want = {}
        for p in points:
            d, name = min((metres(p, s), s[0]) for s in some)
            if math.ceil(d / 64) <= 30:
                want[p[0]] = (name, max(1, math.ceil(d / 64)))
        got = stations.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), frame, "id", where)
        assert {r["id"]: (r["station"], r["minutes"]) for r in got.collect()} == want and 0 < len(want) < 150


def test_cited_stations(spark):
    s = [("tram", 0.0, 0.0, "service", None, 1), ("train", 0.01, 0.0, "service", [], 2), ("soon", 0.002, 0.0, "works", None, 1), ("plan", 0.5, 0.0, "service", ["X"], 2)]
    frame = spark.createDataFrame(s, "station string, lon double, lat double, status string, planned array<string>, rank int")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0018, 0.0), (3, 0.0095, 0.0), (4, 0.5, 0.001), (5, 3.0, 3.0), (6, -0.0165, 0.0)], "id long, lon double, lat double")
    got = {(r["id"], r["role"], r["station"]) for r in stations.cited(points, frame, "id").collect()}
    assert got == {(1, "service", "tram"), (1, "train", "train"), (2, "service", "tram"), (2, "project", "soon"), (2, "train", "train"), (3, "service", "train"), (4, "service", "plan"), (6, "service", "tram")}


def test_line_order_takes_any_number(spark):
    names = ["L 99999999999", "L 2", "Tram 3", "RER A", "L 100", "Metro 12", "Metro 2"]
    got = spark.createDataFrame([(names,)], "x array<string>").select(stations.line_order(F.col("x"))).first()[0]
    assert got == ["RER A", "Metro 2", "Metro 12", "Tram 3", "L 2", "L 100", "L 99999999999"]
