"""What differed, or grew faster than its input, on larger tables."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from arpent import catalogue
from arpent.operators import geo, stations
from arpent.sources import columns
from arpent.sources.stores import Scratch

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


def _tables(tmp_path, **selects):
    """A folder of the smallest tables, some of them replaced by what a SELECT over them gives."""
    con = connect(SF)
    for (name,) in con.execute("SELECT table_name FROM information_schema.tables").fetchall():
        con.execute(f"COPY ({selects.get(name, f'SELECT * FROM {name}')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def _holds(spark, query, d):
    same(catalogue.QUERIES[query](spark, d), connect(d).execute(catalogue.ORACLES[query]))


def test_source_files_keep_the_order_of_lines(spark, tmp_path):
    # three lines of one premise; the last in the table is the first by its order and has another private area
    line = "SELECT * REPLACE ({0}::BIGINT AS l_partkey, 0::BIGINT AS l_orderkey, 1::INT AS l_linenumber, 10.0 AS l_quantity, {1} AS l_discount, 0.0 AS l_tax, 'A' AS l_returnflag) FROM (SELECT * FROM lineitem LIMIT 1)"
    d = _tables(tmp_path, lineitem=" UNION ALL ".join(line.format(k, x) for k, x in ((7, 0.05), (5, 0.05), (3, 0.0))), part="SELECT * REPLACE (1::INT AS p_size) FROM part")
    _holds(spark, "file_to_sales", d)
    assert catalogue.QUERIES["file_to_sales"](spark, d).first()["private_area"] == 0.0


def test_rings_keep_no_split_within_a_side(spark, tmp_path):
    # a tall ring, whose point farthest from the start is none of its corners
    ring = [(0.0, 0.0), (0.01, 0.0), (0.01, 9.0), (0.0095, 9.000002), (0.0, 9.0), (0.0, 0.0)]
    assert geo.simplify_ring(ring, 7e-5, 0.3) == [(0.0, 0.0), (0.01, 0.0), (0.01, 9.0), (0.0, 9.0), (0.0, 0.0)]
    corner = [(0.0, 0.0), (0.01, 0.0), (0.01, 9.0), (0.0095, 9.001), (0.0, 9.0), (0.0, 0.0)]
    assert geo.simplify_ring(corner, 7e-5, 0.3) == corner
    _holds(spark, "simplify_rings", _tables(tmp_path, customer="SELECT c.* FROM customer c, range(6000)"))


def _largest_join(spark):
    """Rows of the largest join of the last execution, as Spark counted them."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in (nodes.apply(k) for k in range(nodes.size())):
        for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
            if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("copies", [True, False])
def test_nearest_station_of_dense_places(spark, copies):
    # 2000 points and 2000 stations within the cap of each other: of one place, then of places of their own
    n, at = F.col("id"), lambda k: F.lit(2.0) + F.col("id") * k % 2003 / F.lit(2e5) * (0 if copies else 1)
    points = spark.range(2000).select("id", at(7).alias("lon"), (at(11) + 46).alias("lat"))
    found = spark.range(2000).select(F.format_string("S%04d", n).alias("station"), at(13).alias("lon"), (at(17) + 46).alias("lat"), F.lit("service").alias("status"), F.lit(None).cast("array<string>").alias("planned"), F.lit(2).alias("rank"))
    got = {r["id"]: (r["station"], r["metres"]) for r in stations.nearest(points, found, "id").collect()}
    assert _largest_join(spark) < 400_000  # of four million pairs
    places = [(r["station"], r["lon"], r["lat"]) for r in found.collect()]
    for r in random.Random(1).sample(points.collect(), 50):
        metres = [(math.hypot((r["lon"] - x) * 111_195.0 * math.cos(math.radians((r["lat"] + y) / 2)), (r["lat"] - y) * 111_195.0), name) for name, x, y in places]
        assert got[r["id"]][0] == min(metres)[1] and math.isclose(got[r["id"]][1], min(metres)[0], abs_tol=1e-6)
    cited = {r["id"]: (r["role"], r["station"], r["metres"]) for r in stations.cited(points, found, "id").collect()}
    assert _largest_join(spark) < 400_000
    assert cited == {k: ("service", *v) for k, v in got.items()}


_STATION = "name string, lon double, lat double, network string, type string, status string, lines array<string>, planned array<string>, ord long"


@pytest.mark.parametrize("lat", [48.0, 88.5])
def test_reconciling_meets_on_a_grid(spark, lat):
    # 1500 stations of one line 2 km apart, each third with a plan of it, of which some are beside or named alike
    rows = [(f"S{k:04d}", k * 0.03, lat, "RER", "station", "service", ["E"], ["E"] if k % 3 == 0 else [], k) for k in range(1500)]
    rows += [(f"P{k}", 3 * k * 0.03 + x, lat + y, "RER", "station", "project", ["E", "F"], None, 9000 + k) for k, (x, y) in enumerate([(0.0005, 0.001), (0.0, 0.002), (0.0, 0.0013)])]
    rows += [("Near s0030", 0.9, lat + 0.003, "RER", "station", "works", ["E", "F"], None, 9100), ("Near s0031", 0.93, lat + 0.004, "RER", "station", "works", ["E"], None, 9101)]
    frame = spark.createDataFrame(rows, _STATION)
    found = stations.reconciled(frame)
    meet = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "lon2" in x]
    assert meet and all(re.search(r"row#\d+L? = row#", x) for x in meet)  # not by line alone
    got = {r["name"]: (r["lines"], r["planned"]) for r in found.collect()}

    def opened(r):
        return any(
            s[5] == "service" and s[0] != r[0]
            and ((d := math.hypot((r[1] - s[1]) * 111_320.0 * math.cos(math.radians((r[2] + s[2]) / 2)), (r[2] - s[2]) * 111_320.0)) <= 150 or (d <= 400 and (r[0].lower().replace(" ", "") in s[0].lower() or s[0].lower() in r[0].lower().replace(" ", ""))))
            for s in rows
        )

    want = {}
    for r in rows:
        plans = r[7] if r[5] == "service" else r[6]
        left = [x for x in plans if not (x == "E" and opened(r))]
        if r[5] == "service" or left or not plans:
            want[r[0]] = (r[6], left) if r[5] == "service" else (left, None)
    assert got == want


def test_merging_gives_names_to_a_fixed_number_of_tasks(spark):
    rows = spark.range(3000).select(F.format_string("N%d", F.col("id") % 1000).alias("name"), F.lit(2.0).alias("lon"), F.when(F.col("id") < 2000, 48.0).otherwise(49.0).alias("lat"), F.lit("RER").alias("network"), F.lit("station").alias("type"), F.lit("service").alias("status"), F.array(F.concat(F.lit("L"), F.col("id").cast("string"))).alias("lines"), F.lit(None).cast("array<string>").alias("planned"), (-F.col("id")).alias("ord"))
    found = stations.merged(rows)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["name"], r["lat"]): (r["lines"], r["ord"]) for r in found.collect()}
    assert len(got) == 2000
    assert got["N7", 48.0] == (["L1007", "L7"], -1007) and got["N7", 49.0] == (["L2007"], -2007)
    empty = rows.where("name = 'N3' AND lat > 48.5").withColumn("lon", F.lit(None).cast("double"))
    assert [(r["lon"], r["lines"]) for r in stations.merged(empty.unionByName(empty)).collect()] == [(None, ["L2003"])] * 2


def test_sales_are_computed_once_for_their_columns(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(price):
        seen.add(1)
        return price

    sales = spark.range(60).select(F.col("id").alias("sale_id"), F.format_string("%05d", F.col("id") % 3).alias("commune"), F.format_string("s%d", F.col("id") % 7).alias("section"), F.lit("House").alias("property_type"), F.lit("Old").alias("state"), F.lit(2020).alias("year"), (F.col("id") * 1000 + 5000.0).alias("price"), F.lit(50.0).alias("area"), F.lit("x").alias("address"))
    counts = sales.where(counted.asNondeterministic()("price") >= 0).withColumn("price_m2", F.rint(F.col("price") / F.col("area")))
    with Scratch(spark) as scratch:
        assert columns.numbered(counts, scratch).count() == 60
    assert seen.value == 60
    columns.publish_columns(counts, f"file://{tmp_path}/c")
    assert seen.value == 120
    got = columns.read_columns(spark, f"file://{tmp_path}/c").orderBy("place").select("commune", "section", "price").collect()
    assert got == sales.orderBy("commune", "price").select("commune", "section", "price").collect()
