"""The model's lines and sales on the driver's star schema, in Spark and as SQL text.

An order is a sale, its lines are premises, customers give place; positions are arithmetic on keys.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators.quality import survivors
from ..operators.reconstruct import reconstruct

BOX = (2.0, 48.6, 2.5, 49.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # the dimensions join with sizes that Spark measures; only lines and orders are dealt by order
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sold = t("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    commune = F.lpad(F.col("c_nationkey").cast("string"), 5, "0")
    section = F.concat(commune, F.substring(F.rpad("c_mktsegment", 5, "X"), 1, 5))
    return rows.select(
        F.col("l_orderkey").alias("sale_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
        F.to_date("o_orderdate").alias("sale_date"),
        F.when(F.col("o_orderstatus") == "P", "Sale").when(F.col("o_orderstatus") == "O", "Off-plan sale").otherwise("Exchange").alias("nature"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("l_returnflag") == "A", "Apartment").when(F.col("l_returnflag") == "R", "House").when(F.col("p_type") == "PROMO", "Local industriel").otherwise("Outbuilding").alias("premise_type"),
        F.when(F.col("l_tax") < 0.075, F.col("l_quantity")).alias("area"),
        F.when(F.col("l_discount") > 0.03, F.col("l_quantity") + 0.5).alias("private_area"),
        F.col("p_size").cast("double").alias("rooms"),
        F.concat(section, F.col("l_linenumber").cast("string")).alias("parcel"),
        section.alias("section"),
        commune.alias("commune"),
        F.col("n_name").alias("commune_name"),
        F.concat(((F.col("l_partkey") % 200) + 1).cast("string"), F.when(F.col("l_partkey") % 3 == 0, " bis ").otherwise(" "), F.col("p_name")).alias("address"),
        ((F.col("l_returnflag") == "N") & (F.col("p_type") == "PROMO")).alias("is_activity"),
        (F.lit(2.0) + (F.col("c_custkey") % 1000) / F.lit(2000.0)).alias("lon"),
        (F.lit(48.6) + (F.col("c_custkey") % 777) / F.lit(1500.0)).alias("lat"),
        F.col("n_regionkey").alias("department"),
    )


LINES_SQL = """lines AS (
  SELECT l_orderkey AS sale_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS ord,
    o_orderdate::DATE AS sale_date,
    CASE o_orderstatus WHEN 'P' THEN 'Sale' WHEN 'O' THEN 'Off-plan sale' ELSE 'Exchange' END AS nature,
    o_totalprice AS price,
    CASE WHEN l_returnflag = 'A' THEN 'Apartment' WHEN l_returnflag = 'R' THEN 'House' WHEN p_type = 'PROMO' THEN 'Local industriel' ELSE 'Outbuilding' END AS premise_type,
    CASE WHEN l_tax < 0.075 THEN l_quantity END AS area,
    CASE WHEN l_discount > 0.03 THEN l_quantity + 0.5 END AS private_area,
    p_size::DOUBLE AS rooms,
    lpad(c_nationkey::VARCHAR, 5, '0') || substr(rpad(c_mktsegment, 5, 'X'), 1, 5) || l_linenumber::VARCHAR AS parcel,
    lpad(c_nationkey::VARCHAR, 5, '0') || substr(rpad(c_mktsegment, 5, 'X'), 1, 5) AS section,
    lpad(c_nationkey::VARCHAR, 5, '0') AS commune, n_name AS commune_name,
    (l_partkey % 200 + 1)::VARCHAR || CASE WHEN l_partkey % 3 = 0 THEN ' bis ' ELSE ' ' END || p_name AS address,
    l_returnflag = 'N' AND p_type = 'PROMO' AS is_activity,
    2.0::DOUBLE + (c_custkey % 1000) / 2000.0::DOUBLE AS lon, 48.6::DOUBLE + (c_custkey % 777) / 1500.0::DOUBLE AS lat,
    n_regionkey AS department
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

SALES_SQL = """numbered AS (
  SELECT *, premise_type IN ('Apartment', 'House') AS dwelling,
    row_number() OVER (PARTITION BY sale_id, parcel, premise_type, area, rooms ORDER BY ord) AS repeat FROM lines
), kept AS (SELECT * FROM numbered WHERE dwelling AND repeat = 1),
of_section AS (
  SELECT sale_id, section, row_number() OVER (PARTITION BY sale_id ORDER BY sum(area) DESC NULLS LAST, section NULLS LAST) AS k FROM kept GROUP BY sale_id, section
), of_line AS (
  SELECT sale_id, address, parcel, row_number() OVER (PARTITION BY sale_id ORDER BY area DESC NULLS LAST, ord) AS k FROM kept
), whole AS (
  SELECT sale_id, max(price) AS price, count(DISTINCT price) AS n_prices, bool_or(is_activity) AS has_activity,
    count(*) FILTER (premise_type = 'Outbuilding') AS n_outbuildings, count(*) FILTER (dwelling AND repeat > 1) AS n_repeats FROM numbered GROUP BY sale_id
), part_of AS (
  SELECT sale_id, min(sale_date) AS sale_date, min_by(nature, ord) AS nature, min_by(commune, ord) AS commune, min_by(commune_name, ord) AS commune_name,
    coalesce(sum(area), 0.0) AS area, coalesce(sum(private_area), 0.0) AS private_area, coalesce(sum(rooms), 0)::BIGINT AS rooms, count(*) AS n_premises,
    string_agg(DISTINCT premise_type, ', ' ORDER BY premise_type) AS premise_types,
    CASE WHEN count(DISTINCT premise_type) = 1 THEN min(premise_type) ELSE 'Mixed' END AS property_type, avg(lon) AS lon, avg(lat) AS lat, min(department) AS department, min(ord) AS ord
  FROM kept GROUP BY sale_id
), sales AS (
  SELECT p.sale_id, sale_date, year(sale_date)::INT AS year, nature, price, n_prices, commune, commune_name, s.section, l.address, l.parcel, area, private_area, rooms,
    n_premises, n_repeats, n_outbuildings, has_activity, premise_types, property_type, lon, lat, department, ord
  FROM part_of p JOIN whole w USING (sale_id) JOIN of_section s ON s.sale_id = p.sale_id AND s.k = 1 JOIN of_line l ON l.sale_id = p.sale_id AND l.k = 1
)"""

JUDGED_SQL = """filled AS (
  SELECT * REPLACE (CASE WHEN area <= 0 AND private_area > 0 THEN private_area ELSE area END AS area), coalesce(area <= 0 AND private_area > 0, false) AS area_fallback FROM sales
), judged AS (
  SELECT *, CASE WHEN nature NOT IN ('Sale', 'Off-plan sale') THEN 'nature' WHEN sale_date IS NULL THEN 'no date' WHEN price IS NULL THEN 'no price'
    WHEN price <= 0 THEN 'price not positive' WHEN price < 1000 THEN 'price too low' WHEN area IS NULL OR area <= 0 THEN 'no area' WHEN area < 8 THEN 'area too small'
    WHEN section IS NULL THEN 'no section' WHEN has_activity THEN 'activity premises' WHEN n_premises >= 3 THEN 'block sale' WHEN property_type = 'Mixed' THEN 'mixed types'
    WHEN price / area < 500 THEN 'price per m2 too low' WHEN price / area > 30000 THEN 'price per m2 too high' END AS rule FROM filled
), clean AS (
  SELECT *, round_even(price / area, 0) AS price_m2, CASE WHEN nature = 'Off-plan sale' THEN 'New' ELSE 'Old' END AS state FROM judged WHERE rule IS NULL
)"""

WITH_LINES = f"WITH {LINES_SQL} "
WITH_SALES = f"WITH {LINES_SQL}, {SALES_SQL} "
WITH_CLEAN = f"WITH {LINES_SQL}, {SALES_SQL}, {JUDGED_SQL} "


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct(lines(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sales with their department (a region key here)."""
    nations = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("commune"), F.col("n_regionkey").alias("department"))
    return survivors(sales(spark, sf_dir)).join(nations, "commune", "left")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("station"), half_even(F.lit(2.0) + (F.col("s_suppkey") * 37 % 500) / F.lit(1000.0), 6).alias("lon"), half_even(F.lit(48.6) + (F.col("s_suppkey") * 53 % 520) / F.lit(1000.0), 6).alias("lat"))


STATIONS_SQL = """stations AS (
  SELECT s_name AS station, round_even((2.0::DOUBLE + (s_suppkey * 37 % 500) / 1000.0::DOUBLE) * 1e6, 0) / 1e6 AS lon,
    round_even((48.6::DOUBLE + (s_suppkey * 53 % 520) / 1000.0::DOUBLE) * 1e6, 0) / 1e6 AS lat FROM supplier
)"""
