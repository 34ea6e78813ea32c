"""All registered queries of the engine, with the SQL that gives the same rows."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as sc
from .operators import boxes, filters, geo, layers, quality, reconstruct, scale, search, stations, tiles, trend, units, vintage, zones
from .plans import standin
from .plans.standin import BOX, STATIONS_SQL, WITH_CLEAN, WITH_LINES, WITH_SALES
from .sources import columns, contours, files, published, unknown
from .sources.stores import Scratch, fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    """Doubles that come from sums in any order are compared to six decimals."""
    return sc.half_even(F.col(c), 6).alias(name or c)


R6 = "(round_even(({0}) * 1e6, 0) / 1e6 + 0.0)"


def q6(expression: str, name: str | None = None) -> str:
    return f"{R6.format(expression)} AS {name or expression}"


# --- reconstruction ---------------------------------------------------------------------------

_SALE_COLUMNS = "sale_id, sale_date, year, nature, price, n_prices, commune, commune_name, section, address, parcel, area, private_area, rooms, n_premises, n_repeats, n_outbuildings, has_activity, premise_types, property_type"


@register(f"{WITH_SALES} SELECT {_SALE_COLUMNS}, {q6('lon')}, {q6('lat')} FROM sales")
def sale_reconstruct(spark, d):
    s = standin.sales(spark, d)
    return s.select(*_SALE_COLUMNS.split(", "), r6("lon"), r6("lat"))


@register(f"{WITH_SALES} SELECT sale_id, count(*) AS n_lines, count(*) FILTER (repeat = 1) AS n_kept FROM numbered WHERE dwelling GROUP BY sale_id")
def dedupe_lines(spark, d):
    rows = standin.lines(spark, d).where(F.col("premise_type").isin(*reconstruct.DWELLINGS))
    return reconstruct.number_repeats(rows).groupBy("sale_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("repeat") == 1).alias("n_kept"))


@register(f"{WITH_SALES} SELECT sale_id, section AS main_section FROM of_section WHERE k = 1")
def main_section(spark, d):
    return reconstruct.main_section(reconstruct.drop_repeats(standin.lines(spark, d)))


@register(f"{WITH_SALES} SELECT sale_id, address AS main_address, parcel AS main_parcel FROM of_line WHERE k = 1")
def main_line(spark, d):
    return reconstruct.main_line(reconstruct.drop_repeats(standin.lines(spark, d)))


@register(f"{WITH_SALES} SELECT sale_id, price, n_prices, has_activity, n_outbuildings FROM whole")
def inconsistent_prices(spark, d):
    return reconstruct.price_of_sale(standin.lines(spark, d))


@register(f"{WITH_SALES} SELECT count(*) FILTER (has_activity) AS n_with_activity, count(*) FILTER (has_activity AND n_premises > 0) AS n_mixed_use, count(*) AS n_sales FROM sales")
def mixed_use_sales(spark, d):
    s = standin.sales(spark, d)
    return s.agg(F.count_if("has_activity").alias("n_with_activity"), F.count_if(F.col("has_activity") & (F.col("n_premises") > 0)).alias("n_mixed_use"), F.count("*").alias("n_sales"))


@register(f"{WITH_SALES} SELECT n_outbuildings, count(*) AS n FROM sales GROUP BY n_outbuildings")
def outbuilding_counts(spark, d):
    return zones.count_by(standin.sales(spark, d), "n_outbuildings")


# --- quality ----------------------------------------------------------------------------------


@register(f"{WITH_CLEAN} SELECT rule, count(*) AS n FROM judged WHERE rule IS NOT NULL GROUP BY rule")
def quality_rejects(spark, d):
    return quality.rejects(standin.sales(spark, d))


@register(f"{WITH_CLEAN} SELECT sale_id, area, price, price_m2, state, property_type FROM clean")
def quality_survivors(spark, d):
    return quality.survivors(standin.sales(spark, d)).select("sale_id", "area", "price", "price_m2", "state", "property_type")


@register(f"{WITH_CLEAN} SELECT sale_id, area, area_fallback FROM filled WHERE area_fallback")
def area_fallback(spark, d):
    return quality.with_area_fallback(standin.sales(spark, d)).where("area_fallback").select("sale_id", "area", "area_fallback")


@register(
    f"{WITH_CLEAN} SELECT count(*) AS n_sales, count(*) FILTER (rule IS NULL) AS n_kept, count(*) FILTER (area_fallback) AS n_fallback, coalesce(sum(n_repeats), 0)::BIGINT AS n_repeats, "
    f"count(*) FILTER (n_prices > 1) AS n_price_conflicts, {q6('count(*) FILTER (rule IS NULL) / count(*)', 'kept_ratio')} FROM judged"
)
def quality_report(spark, d):
    out = quality.report(standin.sales(spark, d))
    return out.withColumn("kept_ratio", r6("kept_ratio"))


# --- filters, perimeters, removals ------------------------------------------------------------


def _filtered(name: str, f: filters.SaleFilter, where: str) -> None:
    def query(spark, d):
        return f.apply(standin.clean(spark, d)).select("sale_id", "year", "area", "property_type", "state", "price_m2")

    query.__name__ = name
    register(f"{WITH_CLEAN} SELECT sale_id, year, area, property_type, state, price_m2 FROM clean WHERE {where}")(query)


_filtered("filter_years_set", filters.SaleFilter(years=(1996, 1999)), "year IN (1996, 1999)")
_filtered("filter_surface_open", filters.SaleFilter(area_min=40), "area >= 40")
_filtered("filter_surface_closed", filters.SaleFilter(area_min=20, area_max=60.5), "area >= 20 AND area <= 60.5")
_filtered("filter_type_state", filters.SaleFilter(types=("House",), states=("New",)), "property_type = 'House' AND state = 'New'")
_filtered("filter_nothing", filters.SaleFilter(years=(), types=None), "true")


@register(f"{WITH_CLEAN} SELECT sale_id, commune FROM clean WHERE commune IN (SELECT lpad(n_nationkey::VARCHAR, 5, '0') FROM nation WHERE n_regionkey = 2)")
def perimeter_semi(spark, d):
    nations = standin.table(spark, d, "nation").where("n_regionkey = 2").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("commune"))
    return filters.within(standin.clean(spark, d), nations).select("sale_id", "commune")


_REMOVED_SQL = "removed AS (SELECT DISTINCT sale_date AS d, commune AS c, lower(trim(regexp_replace(address, '\\s+', ' ', 'g'))) AS a FROM clean WHERE sale_id % 50 = 7)"


@register(f"{WITH_CLEAN}, {_REMOVED_SQL} SELECT sale_id FROM clean ANTI JOIN removed ON sale_date = d AND commune = c AND lower(trim(regexp_replace(address, '\\s+', ' ', 'g'))) = a")
def removals_anti(spark, d):
    s = standin.clean(spark, d)
    # requests name some sales by date, commune and an address in another spelling
    asked = s.where("sale_id % 50 = 7").select(F.col("sale_date").alias("removed_date"), F.col("commune").alias("removed_commune"), F.concat(F.lit("  "), F.upper(F.replace("address", F.lit(" "), F.lit("  ")))).alias("removed_address"))
    return filters.without_removed(s, asked).select("sale_id")


@register(f"{WITH_CLEAN} SELECT section, count(*) AS n FROM clean WHERE section NOT IN (SELECT DISTINCT section FROM clean WHERE section LIKE '%BUILD%' OR section LIKE '%AUTOM%') GROUP BY section")
def orphans_anti(spark, d):
    s = standin.clean(spark, d)
    return vintage.orphans(s, s.where("section LIKE '%BUILD%' OR section LIKE '%AUTOM%'"))


@register(f"{WITH_CLEAN} SELECT sale_id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, commune_name) AS name FROM clean LEFT JOIN nation ON commune = lpad(n_nationkey::VARCHAR, 5, '0')")
def official_names(spark, d):
    names = standin.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("commune"), F.col("n_name").alias("official"))
    return standin.clean(spark, d).join(names, "commune", "left").select("sale_id", F.coalesce("official", "commune_name").alias("name"))


@register(f"{WITH_CLEAN} SELECT sale_id, sale_date, address FROM clean WHERE lower(commune_name) LIKE '%nation_1%' AND lower(address) LIKE '%ring%' AND sale_date::VARCHAR LIKE '1997%'")
def sale_search(spark, d):
    return filters.search(standin.clean(spark, d), "NATION_1", "Ring", "1997").select("sale_id", "sale_date", "address")


# --- zones ------------------------------------------------------------------------------------


def _zone_sql(key: str) -> str:
    return (
        f"{WITH_CLEAN} SELECT {key} AS zone, count(*) AS n_sales, median(price_m2) AS median_m2, round_even(avg(price_m2), 0) AS mean_m2, round_even(median(price), 0) AS median_price, "
        f"round_even(avg(price), 0) AS mean_price, round_even(median(area), 0) AS median_area FROM clean WHERE {key} IS NOT NULL GROUP BY {key}"
    )


@register(_zone_sql("commune"))
def zone_stats_commune(spark, d):
    return zones.statistics(standin.clean(spark, d), "commune")


@register(_zone_sql("section"))
def zone_stats_section(spark, d):
    return zones.statistics(standin.clean(spark, d), "section")


@register(
    f"{WITH_CLEAN} SELECT CASE WHEN grouping(section) = 0 THEN 'section' ELSE 'commune' END AS grain, coalesce(section, commune) AS zone, count(*) AS n_sales, median(price_m2) AS median_m2, "
    "round_even(avg(price), 0) AS mean_price FROM clean WHERE section IS NOT NULL AND commune IS NOT NULL GROUP BY GROUPING SETS ((section), (commune))"
)
def zone_stats_two_grains(spark, d):
    return zones.statistics_of_both(standin.clean(spark, d))


_END_SQL = "{t}.sale_id AS {e}_sale, {t}.price AS {e}_price, {t}.area AS {e}_area, {t}.price_m2 AS {e}_m2, {t}.property_type AS {e}_type, {t}.sale_date AS {e}_date"


@register(
    f"{WITH_CLEAN}, high AS (SELECT *, row_number() OVER (PARTITION BY commune ORDER BY price DESC, sale_date, ord, sale_id) AS k FROM clean), "
    "low AS (SELECT *, row_number() OVER (PARTITION BY commune ORDER BY price, sale_date, ord, sale_id) AS k FROM clean) "
    f"SELECT h.commune AS zone, {_END_SQL.format(t='h', e='max')}, {_END_SQL.format(t='l', e='min')} FROM high h JOIN low l ON h.commune = l.commune WHERE h.k = 1 AND l.k = 1"
)
def zone_extremes(spark, d):
    return zones.extremes(standin.clean(spark, d), "commune")


@register(f"{WITH_CLEAN} SELECT section AS zone, year, median(price_m2) AS value, count(*) AS n FROM clean GROUP BY section, year")
def annual_medians(spark, d):
    return zones.by_year(standin.clean(spark, d), "section")


@register(f"{WITH_CLEAN} SELECT commune AS zone, year, {q6('avg(price)', 'value')}, count(*) AS n FROM clean GROUP BY commune, year")
def annual_mean_price(spark, d):
    return zones.by_year(standin.clean(spark, d), "commune", "mean_price").withColumn("value", r6("value"))


@register(
    f"{WITH_CLEAN}, counted AS (SELECT section, commune_name, count(*) AS n, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, commune_name) AS k FROM clean GROUP BY section, commune_name) "
    "SELECT section AS zone, commune_name || ' ' || section AS label, n FROM counted WHERE k = 1"
)
def dominant_label(spark, d):
    return zones.labels(standin.clean(spark, d), "section")


_STREET_SQL = r"trim(regexp_replace(address, '^\s*\d+\s*(?:(?:bis|ter|quater|quinquies)\b|[a-z]\b)?\s*', '', 'i'))"


_STREETS_SQL = (
    f"streets_counted AS (SELECT section, {_STREET_SQL} AS street, count(*) AS n FROM clean GROUP BY 1, 2), streets_long AS (SELECT * FROM streets_counted WHERE length(street) > 2), "
    "streets_ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, street) AS k FROM streets_long), "
    "streets AS (SELECT section AS zone, string_agg(street, ', ' ORDER BY k) AS streets FROM streets_ranked WHERE k <= 3 GROUP BY section)"
)


@register(f"{WITH_CLEAN}, {_STREETS_SQL} SELECT * FROM streets")
def dominant_streets(spark, d):
    return zones.main_streets(standin.clean(spark, d), "section")


@register(
    f"{WITH_CLEAN} SELECT string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years, string_agg(DISTINCT property_type, ',' ORDER BY property_type) AS types, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM clean"
)
def filter_domain(spark, d):
    return zones.filter_values(standin.clean(spark, d))


@register(f"{WITH_CLEAN} SELECT (floor(quantile_cont(area, 0.99) / 50) * 50 + 50)::BIGINT AS ceiling FROM clean")
def surface_ceiling(spark, d):
    return zones.area_ceiling(standin.clean(spark, d))


@register(f"{WITH_CLEAN} SELECT min(sale_date) AS first_date, max(sale_date) AS last_date FROM clean")
def coverage_dates(spark, d):
    return zones.coverage(standin.clean(spark, d))


@register(
    f"{WITH_CLEAN} SELECT {q6('quantile_cont(lon, 0.01)', 'west')}, {q6('quantile_cont(lat, 0.01)', 'south')}, {q6('quantile_cont(lon, 0.99)', 'east')}, {q6('quantile_cont(lat, 0.99)', 'north')} "
    "FROM clean WHERE lon BETWEEN 2.0 AND 2.5 AND lat BETWEEN 48.6 AND 49.2"
)
def opening_frame(spark, d):
    return zones.opening_frame(standin.clean(spark, d), BOX)


@register(
    "SELECT r_name AS name, count(*) AS n_communes, string_agg(DISTINCT lpad(n_nationkey::VARCHAR, 5, '0'), ',' ORDER BY lpad(n_nationkey::VARCHAR, 5, '0')) AS communes, coalesce(sum(pop), 0)::BIGINT AS population "
    "FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1) ON n_nationkey = c_nationkey GROUP BY r_name"
)
def territory_rollup(spark, d):
    people = standin.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pop"))
    n = standin.table(spark, d, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(standin.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    codes = F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))), ",")
    return n.groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n_communes"), codes.alias("communes"), F.coalesce(F.sum("pop"), F.lit(0)).alias("population"))


# --- trend ------------------------------------------------------------------------------------


def _trend_sql(key: str, least_sales: int = 5, least_years: int = 3, where: str = "true") -> str:
    return f"""{WITH_CLEAN}, annual AS (
      SELECT {key} AS zone, year, median(price_m2) AS value, count(*) AS n FROM clean WHERE {where} GROUP BY {key}, year HAVING count(*) >= {least_sales} AND median(price_m2) > 0
    ), sums AS (
      SELECT zone, count(*) AS n_years, sum(n)::BIGINT AS n_sales, sum(n)::DOUBLE AS w, sum(n * a)::DOUBLE AS wa, sum(n * l) AS wl, sum(n * a * a)::DOUBLE AS waa, sum(n * a * l) AS wal, sum(n * l * l) AS wll,
        min(year) AS first_year, max(year) AS last_year FROM (SELECT *, year - (SELECT min(year) FROM annual) AS a, ln(value) AS l FROM annual) GROUP BY zone
    ), parts AS (
      SELECT *, waa - wa * wa / w AS spread, wal - wa * wl / w AS cov, wll - wl * wl / w AS var FROM sums
    ), trends AS (
      SELECT zone, n_years, n_sales, first_year, last_year, n_years >= {max(least_years, 2)} AND last_year > first_year AND spread > 0 AS reliable,
        CASE WHEN reliable THEN cov / spread END AS slope, var, cov FROM parts
    ), trend AS (
      SELECT zone, n_years, n_sales, first_year, last_year, reliable, {q6('(exp(slope) - 1) * 100', 'rate')}, {q6('(exp(slope * (last_year - first_year)) - 1) * 100', 'change')},
        CASE WHEN reliable AND var > 0 THEN {R6.format('slope * cov / var')} END AS r2 FROM trends
    )"""


_TREND_COLUMNS = ("zone", "n_years", "n_sales", "first_year", "last_year", "reliable")


def _rounded_trend(t: DataFrame) -> DataFrame:
    return t.select(*_TREND_COLUMNS, r6("rate"), r6("change"), r6("r2"))


@register(_trend_sql("commune") + " SELECT * FROM trend")
def trend_commune(spark, d):
    return _rounded_trend(trend.trend(standin.clean(spark, d), "commune"))


@register(_trend_sql("section") + " SELECT * FROM trend")
def trend_section(spark, d):
    return _rounded_trend(trend.trend(standin.clean(spark, d), "section"))


@register(_trend_sql("section", where="year IN (1996, 1997)") + " SELECT * FROM trend")
def trend_two_years_unreliable(spark, d):
    return _rounded_trend(trend.trend(filters.SaleFilter(years=(1996, 1997)).apply(standin.clean(spark, d)), "section"))


_AMPLITUDE_SQL = "amp AS (SELECT CASE WHEN m IS NULL THEN 2.0 WHEN s <= 2 THEN 2.0 WHEN s <= 3 THEN 3.0 WHEN s <= 5 THEN 5.0 WHEN s <= 8 THEN 8.0 WHEN s <= 12 THEN 12.0 ELSE 20.0 END::DOUBLE AS amplitude FROM (SELECT m, CASE WHEN q > 0 THEN q ELSE m END AS s FROM (SELECT quantile_cont(abs(rate), 0.9) AS q, max(abs(rate)) AS m FROM trend WHERE reliable)))"


@register(_trend_sql("commune") + f", {_AMPLITUDE_SQL} SELECT amplitude FROM amp")
def trend_amplitude(spark, d):
    return trend.amplitude(trend.trend(standin.clean(spark, d), "commune"))


def _colour_sql(position: str, palette: tuple[str, ...]) -> str:
    last = len(palette) - 1
    channels = []
    for k in (1, 3, 5):
        values = "[" + ", ".join(str(int(c[k : k + 2], 16)) for c in palette) + "]"
        low, high = f"{values}[floor(pos)::INT + 1]", f"{values}[least(floor(pos)::INT + 1, {last}) + 1]"
        channels.append(f"printf('%02x', round_even({low} + ({high} - {low}) * (pos - floor(pos)), 0)::INT)")
    return f"CASE WHEN ({position}) IS NULL THEN '{sc.GREY}' ELSE (SELECT '#' || {' || '.join(channels)} FROM (SELECT greatest(least({position}, 1.0), 0.0) * {last} AS pos)) END"


@register(_trend_sql("commune") + f", {_AMPLITUDE_SQL} SELECT zone, rate, {_colour_sql('CASE WHEN reliable THEN (rate + amplitude) / (2 * amplitude) END', sc.TREND_PALETTE)} AS colour FROM trend, amp")
def trend_colours(spark, d):
    t = _rounded_trend(trend.trend(standin.clean(spark, d), "commune"))
    return trend.coloured(t).select("zone", "rate", "colour")


# --- scales and layers ------------------------------------------------------------------------

_STATS_SQL = _zone_sql("section").replace(" SELECT section AS zone", ", stats AS (SELECT section AS zone", 1) + ")"
_SCALE_SQL = """, used AS (SELECT median_m2 AS v FROM stats WHERE n_sales > 4 OR NOT EXISTS (SELECT 1 FROM stats WHERE n_sales > 4)),
q AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b, min(v) AS lo, max(v) AS hi, count(v) = 0 AS empty FROM used),
q2 AS (SELECT CASE WHEN a >= b THEN lo ELSE a END AS a, CASE WHEN a >= b THEN hi ELSE b END AS b, empty FROM q),
scale AS (SELECT coalesce(CASE WHEN a >= b THEN a - 0.5 ELSE a END, 0.0) AS low, coalesce(CASE WHEN a >= b THEN b + 0.5 ELSE b END, 1.0) AS high, empty FROM q2)"""


@register(f"{_STATS_SQL}{_SCALE_SQL} SELECT {q6('low')}, {q6('high')}, empty FROM scale")
def colour_scale_bounds(spark, d):
    return scale.scale(zones.statistics(standin.clean(spark, d), "section")).select(r6("low"), r6("high"), "empty")


@register(f"{_STATS_SQL}{_SCALE_SQL} SELECT k AS tick, {q6('low + k / 4.0 * (high - low)', 'value')} FROM scale, (SELECT unnest(range(5))::INT AS k)")
def colour_scale_ticks(spark, d):
    return scale.ticks(scale.scale(zones.statistics(standin.clean(spark, d), "section"))).withColumn("value", r6("value"))


@register(f"{_STATS_SQL} SELECT zone, n_sales, n_sales <= 4 AS greyed FROM stats")
def greyed_zones(spark, d):
    return scale.zone_colours(zones.statistics(standin.clean(spark, d), "section")).select("zone", "n_sales", "greyed")


_ZONE_COLOUR = _colour_sql("(median_m2 - low) / (high - low)", sc.PRICE_PALETTE)


@register(f"{_STATS_SQL}{_SCALE_SQL} SELECT zone, median_m2, CASE WHEN n_sales <= 4 THEN '{sc.GREY}' ELSE {_ZONE_COLOUR} END AS colour FROM stats, scale")
def zone_colours(spark, d):
    return scale.zone_colours(zones.statistics(standin.clean(spark, d), "section")).select("zone", "median_m2", "colour")


@register(
    f"{_STATS_SQL}{_SCALE_SQL}, {_STREETS_SQL}, names AS (SELECT section, min(commune_name) AS commune_name FROM clean GROUP BY section) "
    f"SELECT s.zone, commune_name || ' ' || s.zone AS label, streets, n_sales, median_m2 AS value, n_sales <= 4 AS greyed, CASE WHEN n_sales <= 4 THEN '{sc.GREY}' ELSE {_ZONE_COLOUR} END AS colour "
    "FROM stats s JOIN names ON s.zone = names.section LEFT JOIN streets ON s.zone = streets.zone, scale"
)
def layer_price(spark, d):
    with Scratch(spark) as scratch:
        s = scratch.written(standin.clean(spark, d).select("section", "commune_name", "address", "price", "area", "price_m2"))
        return scratch.result(scale.price_layer(zones.statistics(s, "section"), zones.labels(s, "section"), zones.main_streets(s, "section")))


@register(
    _trend_sql("commune") + f", {_AMPLITUDE_SQL}, stats AS (SELECT commune AS zone, count(*) AS n_sales FROM clean GROUP BY commune) "
    f"SELECT stats.zone, stats.n_sales, CASE WHEN reliable THEN rate END AS rate, CASE WHEN reliable THEN r2 END AS r2, coalesce(n_years, 0) AS n_years, {_colour_sql('CASE WHEN reliable THEN (rate + amplitude) / (2 * amplitude) END', sc.TREND_PALETTE)} AS colour "
    "FROM stats LEFT JOIN trend ON stats.zone = trend.zone, amp"
)
def layer_trend(spark, d):
    s = standin.clean(spark, d)
    return scale.trend_layer(zones.statistics(s, "commune"), _rounded_trend(trend.trend(s, "commune")))


_EUROS = "replace(format('{{:,}}', round_even({0}, 0)::BIGINT), ',', ' ')"
_LEGEND_TICKS = ", ".join(_EUROS.format(f"(low + {k / 4} * (high - low))") for k in range(5))


def _texts(row, *arrays):
    return row.select(*(F.array_join(c, "|").alias(c) if c in arrays else c for c in row.columns))


@register(f"{_STATS_SQL}{_SCALE_SQL} SELECT 'Median price' AS title, '{'|'.join(sc.PRICE_PALETTE)}' AS palette, concat_ws('|', {_LEGEND_TICKS}) AS ticks, 'Grey: few sales' AS note FROM scale")
def legend_price(spark, d):
    return _texts(scale.price_legend(scale.scale(zones.statistics(standin.clean(spark, d), "section")), "Median price", "Grey: few sales"), "palette", "ticks")


@register(
    _trend_sql("commune") + f", {_AMPLITUDE_SQL} SELECT 'Yearly change' AS title, '{'|'.join(sc.TREND_PALETTE)}' AS palette, 'Grey: few years' AS note, "
    "replace(format('{:+.1f} %/an|+0.0 %/an|{:+.1f} %/an', -amplitude, amplitude), '.', ',') AS ticks FROM amp"
)
def legend_trend(spark, d):
    return _texts(scale.trend_legend(trend.amplitude(trend.trend(standin.clean(spark, d), "commune")), "Yearly change", "Grey: few years"), "palette", "ticks")


@register(f"{_STATS_SQL}{_SCALE_SQL} SELECT {q6('low')}, {q6('high')}, empty, '{'|'.join(sc.PRICE_PALETTE)}' AS palette, 'm2' AS \"column\" FROM scale")
def scale_of_sales(spark, d):
    return _texts(scale.sales_scale(scale.scale(zones.statistics(standin.clean(spark, d), "section"))).withColumns({"low": r6("low"), "high": r6("high")}), "palette")


@register(
    f"{WITH_CLEAN} SELECT string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR) AS years, 0.0::DOUBLE AS low, (floor(quantile_cont(area, 0.99) / 50) * 50 + 50)::DOUBLE AS high, true AS open_ended, "
    "string_agg(DISTINCT property_type, '|' ORDER BY property_type) AS types, string_agg(DISTINCT state, '|' ORDER BY state) AS states FROM clean"
)
def filters_at_opening(spark, d):
    return _texts(filters.default_filters(standin.clean(spark, d)), "years", "types", "states")


@register(f"SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'n/d' ELSE {_EUROS.format('o_totalprice')} || ' €' END AS euros, CASE WHEN o_orderkey % 50 = 0 THEN 'n/d' ELSE replace(format('{{:+.1f}} %/an', o_totalprice / 9973 - 20), '.', ',') END AS rate FROM orders")
def number_labels(spark, d):
    x = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))
    return standin.table(spark, d, "orders").select("o_orderkey", sc.euro_label(x).alias("euros"), sc.rate_label(x / 9973 - 20).alias("rate"))


# --- vintages ---------------------------------------------------------------------------------

_OLD, _NEW = "year <= 2000", "year >= 1996 AND sale_id % 9 <> 0"
_PAIR_SQL = f"{WITH_CLEAN}, old AS (SELECT * FROM clean WHERE {_OLD}), new AS (SELECT * FROM clean WHERE {_NEW}), span AS (SELECT greatest((SELECT min(sale_date) FROM old), (SELECT min(sale_date) FROM new)) AS f, least((SELECT max(sale_date) FROM old), (SELECT max(sale_date) FROM new)) AS t), old2 AS (SELECT old.* FROM old, span WHERE sale_date BETWEEN f AND t), new2 AS (SELECT new.* FROM new, span WHERE sale_date BETWEEN f AND t)"


def _pair(spark, d):
    s = standin.clean(spark, d)
    return s.where(_OLD), s.where(_NEW)


@register(f"{_PAIR_SQL} SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT year, count(*) AS n FROM old GROUP BY 1) a FULL JOIN (SELECT year, count(*) AS n FROM new GROUP BY 1) b ON a.year = b.year")
def vintage_full_outer_years(spark, d):
    return vintage.compare(*_pair(spark, d), "year")


@register(f"{_PAIR_SQL} SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT year, count(*) AS n FROM old2 GROUP BY 1) a FULL JOIN (SELECT year, count(*) AS n FROM new2 GROUP BY 1) b ON a.year = b.year")
def vintage_equal_period(spark, d):
    return vintage.compare(*vintage.same_period(*_pair(spark, d)), "year")


@register(f"{_PAIR_SQL} SELECT coalesce(a.department, b.department) AS department, a.m AS before, b.m AS after FROM (SELECT department, median(price_m2) AS m FROM old2 GROUP BY 1) a FULL JOIN (SELECT department, median(price_m2) AS m FROM new2 GROUP BY 1) b ON a.department = b.department")
def vintage_department_medians(spark, d):
    return vintage.compare(*vintage.same_period(*_pair(spark, d)), "department", F.median("price_m2"))


@register(f"{WITH_CLEAN}, old AS (SELECT DISTINCT commune FROM clean WHERE commune <> '00003'), new AS (SELECT DISTINCT commune FROM clean WHERE commune > '00001') SELECT commune, 'gone' AS change FROM old WHERE commune NOT IN (SELECT commune FROM new) UNION ALL SELECT commune, 'come' FROM new WHERE commune NOT IN (SELECT commune FROM old)")
def vintage_commune_diff(spark, d):
    s = standin.clean(spark, d)
    return vintage.commune_changes(s.where("commune <> '00003'"), s.where("commune > '00001'"))


_GUARD_SQL = f"""{WITH_CLEAN}, old AS (SELECT * FROM clean), new AS (SELECT * FROM clean WHERE commune > '00004' AND (year <> 1998 OR sale_id % 3 = 0)),
y AS (SELECT a.year, a.n AS before, coalesce(b.n, 0) AS after FROM (SELECT year, count(*) AS n FROM old GROUP BY 1) a LEFT JOIN (SELECT year, count(*) AS n FROM new GROUP BY 1) b ON a.year = b.year),
m AS (SELECT a.department, a.m AS before, b.m AS after FROM (SELECT department, median(price_m2) AS m FROM old GROUP BY 1) a JOIN (SELECT department, median(price_m2) AS m FROM new GROUP BY 1) b ON a.department = b.department),
t AS (SELECT (SELECT count(*) FROM old)::DOUBLE AS before, (SELECT count(*) FROM new)::DOUBLE AS after),
g AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT commune FROM old EXCEPT SELECT DISTINCT commune FROM new))
SELECT 'total' AS rule, 'all' AS subject, before, after FROM t WHERE after < 0.7 * before
UNION ALL SELECT 'year', year::VARCHAR, before::DOUBLE, after::DOUBLE FROM y WHERE after < 0.9 * before
UNION ALL SELECT 'median price', department::VARCHAR, before, after FROM m WHERE abs(after / before - 1) > 0.05
UNION ALL SELECT 'communes lost', 'all', 0.0, n FROM g WHERE n > 3"""


@register(_GUARD_SQL)
def vintage_guardrails(spark, d):
    with Scratch(spark) as scratch:
        s = scratch.written(standin.clean(spark, d).select("sale_id", "year", "commune", "department", "sale_date", "price_m2"))
        return scratch.result(vintage.guard_rails(s, s.where("commune > '00004' AND (year <> 1998 OR sale_id % 3 = 0)")))


@register(
    "WITH p AS (SELECT DISTINCT year(o_orderdate::DATE) AS year, CASE WHEN year(o_orderdate::DATE) % 3 <> 0 THEN (month(o_orderdate::DATE) + 5) // 6 END AS half FROM orders UNION SELECT DISTINCT year(o_orderdate::DATE), NULL FROM orders WHERE year(o_orderdate::DATE) % 4 = 0), "
    "q AS (SELECT '/file/' || year || coalesce('-s' || half, '') || '/x.gz' AS url, year::INT AS year, make_date(year, CASE WHEN half = 2 THEN 7 ELSE 1 END, 1) AS first_day, CASE WHEN half = 1 THEN make_date(year, 6, 30) ELSE make_date(year, 12, 31) END AS last_day FROM p), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY last_day - first_day DESC, first_day) AS k FROM q WHERE last_day >= DATE '1994-04-01' AND first_day <= DATE '1999-03-31') SELECT url, year, first_day, last_day FROM r WHERE k = 1"
)
def sliding_window_periods(spark, d):
    """Files by the periods of orders: halves, whole years, and both for some years."""
    day = F.to_date("o_orderdate")
    half = F.when(F.year(day) % 3 != 0, F.concat(F.lit("-s"), F.ceil(F.month(day) / 6).cast("string"))).otherwise("")
    o = standin.table(spark, d, "orders")
    listed = o.select(F.year(day).alias("y"), half.alias("h")).unionByName(o.where(F.year(day) % 4 == 0).select(F.year(day).alias("y"), F.lit("").alias("h"))).distinct()
    urls = listed.select(F.concat(F.lit("/file/"), F.col("y").cast("string"), "h", F.lit("/x.gz")).alias("url"))
    return vintage.sliding_window(vintage.periods_of(urls), "1999-03-31").select("url", "year", "first_day", "last_day")


_REPORT_SQL = f"""{_PAIR_SQL}, y AS (SELECT coalesce(a.year, b.year)::VARCHAR AS subject, a.n::DOUBLE AS before, b.n::DOUBLE AS after FROM (SELECT year, count(*) AS n FROM old GROUP BY 1) a FULL JOIN (SELECT year, count(*) AS n FROM new GROUP BY 1) b ON a.year = b.year),
p AS (SELECT coalesce(a.department, b.department)::VARCHAR AS subject, a.m AS before, b.m AS after FROM (SELECT department, median(price_m2) AS m FROM old GROUP BY 1) a FULL JOIN (SELECT department, median(price_m2) AS m FROM new GROUP BY 1) b ON a.department = b.department),
e AS (SELECT coalesce(a.department, b.department)::VARCHAR AS subject, a.m AS before, b.m AS after FROM (SELECT department, median(price_m2) AS m FROM old2 GROUP BY 1) a FULL JOIN (SELECT department, median(price_m2) AS m FROM new2 GROUP BY 1) b ON a.department = b.department),
c AS (SELECT 'gone' AS part, commune, 1.0::DOUBLE AS before, NULL::DOUBLE AS after FROM (SELECT DISTINCT commune FROM old EXCEPT SELECT DISTINCT commune FROM new) UNION ALL SELECT 'come', commune, NULL, 1.0 FROM (SELECT DISTINCT commune FROM new EXCEPT SELECT DISTINCT commune FROM old)),
every AS (SELECT 'sales' AS part, 'all' AS subject, (SELECT count(*) FROM old)::DOUBLE AS before, (SELECT count(*) FROM new)::DOUBLE AS after UNION ALL SELECT 'year', * FROM y UNION ALL SELECT 'price', * FROM p UNION ALL SELECT 'same period', * FROM e UNION ALL SELECT part, commune, before, after FROM c)
SELECT part, subject, before, after, {q6('CASE WHEN before > 0 THEN (after / before - 1) * 100 END', 'change')} FROM every"""


@register(_REPORT_SQL)
def vintage_report(spark, d):
    with Scratch(spark) as scratch:
        s = scratch.written(standin.clean(spark, d).select("sale_id", "year", "commune", "commune_name", "department", "sale_date", "price_m2", "section"))
        return scratch.result(vintage.report(s.where(_OLD), s.where(_NEW))).select("part", "subject", "before", "after", r6("change"))


# --- tiles and columns ------------------------------------------------------------------------

_POINTS_SQL = WITH_CLEAN + """, rounded AS (SELECT *, round_even(lon * 1e5, 0) / 1e5 AS rlon, round_even(lat * 1e5, 0) / 1e5 AS rlat FROM clean WHERE lon BETWEEN 1.98 AND 2.52 AND lat BETWEEN 48.58 AND 49.22),
points AS (SELECT *, floor((rlon + 180.0) / 360.0 * 16384)::BIGINT AS x, floor((1.0 - asinh(tan(radians(rlat))) / pi()) / 2.0 * 16384)::BIGINT AS y FROM rounded)"""


def _points(spark, d):
    return tiles.placed(standin.clean(spark, d), BOX)


@register(f"{_POINTS_SQL} SELECT sale_id, x, y FROM points")
def tile_xy(spark, d):
    return _points(spark, d).select("sale_id", "x", "y")


@register(f"{_POINTS_SQL} SELECT x, y, rlon AS lon, rlat AS lat, count(*) AS n, median(price_m2) AS median_m2, CASE WHEN count(DISTINCT property_type) = 1 THEN min(property_type) ELSE 'Mixed' END AS icon FROM points GROUP BY x, y, rlon, rlat")
def tile_locations(spark, d):
    return tiles.locations(_points(spark, d))


@register(f"{_POINTS_SQL}, g AS (SELECT x, y, rlon AS lon, rlat AS lat, count(*) AS n FROM points GROUP BY x, y, rlon, rlat) SELECT x, y, lon, lat, n, row_number() OVER w AS k, (coalesce(sum(n) OVER (PARTITION BY x, y ORDER BY lon, lat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM g WINDOW w AS (PARTITION BY x, y ORDER BY lon, lat)")
def tile_offsets(spark, d):
    return tiles.offsets(_points(spark, d))


@register(f"{_POINTS_SQL} SELECT x, y, address AS text, (dense_rank() OVER (PARTITION BY x, y ORDER BY address) - 1)::INT AS id FROM (SELECT DISTINCT x, y, address FROM points)")
def tile_dictionary(spark, d):
    return tiles.dictionary(_points(spark, d), "address")


@register(f"{_POINTS_SQL} SELECT sale_id, x, y FROM points WHERE x BETWEEN 8290 AND 8293 AND y BETWEEN 5630 AND 5635")
def tile_view(spark, d):
    return tiles.in_view(_points(spark, d), 8290, 5630, 8293, 5635).select("sale_id", "x", "y")


@register()
def tile_payloads(spark, d):
    return tiles.payloads(_points(spark, d))


@register(
    f"{_POINTS_SQL} SELECT x, y, rlon AS lon, rlat AS lat, year AS an, coalesce(round_even(rooms, 0), -1)::BIGINT AS pi, coalesce(round_even(area, 0), -1)::BIGINT AS su, coalesce(round_even(price, 0), -1)::BIGINT AS va, coalesce(price_m2, -1)::BIGINT AS m2, "
    "(year(sale_date) * 10000 + month(sale_date) * 100 + day(sale_date))::BIGINT AS dt, property_type AS ty, state AS et, address AS ad FROM points"
)
def tile_contents(spark, d):
    """The sales that the tiles' contents give back."""
    return tiles.opened(tiles.payloads(_points(spark, d)))


@register(f"{WITH_CLEAN} SELECT sale_id, floor(price)::BIGINT AS euros, round_even((price - floor(price)) * 100, 0)::BIGINT AS cents, (year(sale_date) * 10000 + month(sale_date) * 100 + day(sale_date))::INT AS date_number, round_even(area, 0)::BIGINT AS whole_area FROM clean")
def binary_parts(spark, d):
    s = standin.clean(spark, d)
    euros, cents = sc.whole_and_hundredths(F.col("price"))
    return s.select("sale_id", euros.alias("euros"), cents.alias("cents"), sc.date_number(F.col("sale_date")).alias("date_number"), sc.whole_or_sentinel(F.col("area")).alias("whole_area"))


@register(f"{WITH_CLEAN}, c AS (SELECT commune, dense_rank() OVER (ORDER BY commune) - 1 AS commune_id FROM (SELECT DISTINCT commune FROM clean)) SELECT sale_id, commune_id::INT AS commune_id, row_number() OVER (PARTITION BY clean.commune ORDER BY price_m2, sale_id)::INT AS place FROM clean JOIN c USING (commune)")
def binary_order(spark, d):
    from pyspark.sql import Window

    with Scratch(spark) as scratch:
        n = scratch.result(columns.numbered(standin.clean(spark, d), scratch))
    return n.select("sale_id", F.col("commune_id").cast("int").alias("commune_id"), F.row_number().over(Window.partitionBy("commune").orderBy("price_m2", "sale_id")).alias("place"))


@register(
    f"{WITH_CLEAN} SELECT row_number() OVER (ORDER BY commune, price_m2, sale_id) - 1 AS place, commune, section, year::BIGINT AS year, property_type, state, price, area, price_m2 FROM clean"
)
def binary_slices(spark, d):
    """Clean sales published as slices of packed columns and read back."""
    path = fresh_dir(spark, "columns")
    columns.publish_columns(standin.clean(spark, d), path)
    return columns.read_columns(spark, path)


# --- scalar functions -------------------------------------------------------------------------


@register(r"SELECT p_partkey, lower(trim(regexp_replace('  12  ' || p_name || '  ß', '\s+', ' ', 'g'))).replace('ß', 'ss') AS address_key FROM part")
def address_key(spark, d):
    return standin.table(spark, d, "part").select("p_partkey", sc.address_key(F.concat(F.lit("  12  "), "p_name", F.lit("  ß"))).alias("address_key"))


@register(f"{WITH_LINES} SELECT sale_id, ord, {_STREET_SQL} AS street FROM lines")
def street_strip_number(spark, d):
    return standin.lines(spark, d).select("sale_id", "ord", sc.street_of(F.col("address")).alias("street"))


@register("SELECT doc_id, regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g') AS name_key FROM documents")
def name_key(spark, d):
    return standin.table(spark, d, "documents").select("doc_id", sc.name_key(F.col("text")).alias("name_key"))


@register(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents('St-' || p_name || ' Ste Élise')), '[^\p{L}\p{N}]+', ' ', 'g'), '\bst\b', 'saint', 'g')).replace(' ste ', ' sainte ') AS search_key FROM part")
def search_key(spark, d):
    return standin.table(spark, d, "part").select("p_partkey", sc.search_key(F.concat(F.lit("St-"), "p_name", F.lit(" Ste Élise"))).alias("search_key"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_totalprice WHEN o_orderkey % 5 = 2 THEN floor(o_totalprice) + 0.5 END AS parsed FROM orders")
def parse_number_tolerant(spark, d):
    o = standin.table(spark, d, "orders")
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit(" "), F.replace(plain, F.lit("."), F.lit(",")))).when(kind == 2, F.concat(F.floor("o_totalprice").cast("string"), F.lit(" ,5"))).when(kind == 3, F.concat(plain, F.lit("d"))).otherwise("nan")
    return o.select("o_orderkey", sc.parse_number(sc.text_or_null(text)).alias("parsed"))


@register("SELECT c_custkey, CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS code, CASE WHEN substr(c, 1, 2) IN ('97', '98') THEN substr(c, 1, 3) ELSE substr(c, 1, 2) END AS department FROM (SELECT c_custkey, (c_custkey * 977)::VARCHAR AS k, CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS c FROM customer)")
def commune_codes(spark, d):
    code = sc.zero_fill((F.col("c_custkey") * 977).cast("string"))
    return standin.table(spark, d, "customer").select("c_custkey", code.alias("code"), sc.department_of(code).alias("department"))


@register("SELECT p_partkey, round_even(p_retailprice / 8, 0) AS whole, round_even(p_retailprice / 8 * 1e5, 0) / 1e5 AS five FROM part")
def half_even_rounding(spark, d):
    return standin.table(spark, d, "part").select("p_partkey", sc.half_even(F.col("p_retailprice") / 8).alias("whole"), sc.half_even(F.col("p_retailprice") / 8, 5).alias("five"))


# --- geometry and stations --------------------------------------------------------------------


def _zones(spark):
    """A square with a hole, a triangle and a zone of two squares, from arithmetic."""
    p = lambda pts: "array(" + ", ".join(f"named_struct('lon', {x}D, 'lat', {y}D)" for x, y in pts) + ")"
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    hole, outer = sq(2.125, 48.75, 0.0625), sq(2.0625, 48.6875, 0.1875)
    zones_ = {"holed": f"array(array({p(outer)}, {p(hole)}))", "triangle": f"array(array({p([(2.25, 48.75), (2.5, 48.75), (2.375, 49.0), (2.25, 48.75)])}))", "double": f"array(array({p(sq(2.0, 49.0, 0.0625))}), array({p(sq(2.125, 49.0, 0.03125))}))"}
    return spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS zone, {v} AS geometry" for k, v in zones_.items()))


_CUSTOMER_POINTS = "pts AS (SELECT c_custkey, 2.0::DOUBLE + (c_custkey % 1000) / 2000.0::DOUBLE AS lon, 48.6::DOUBLE + (c_custkey % 777) / 1500.0::DOUBLE AS lat FROM customer)"


def _customers(spark, d):
    return standin.table(spark, d, "customer").select("c_custkey", (F.lit(2.0) + (F.col("c_custkey") % 1000) / F.lit(2000.0)).alias("lon"), (F.lit(48.6) + (F.col("c_custkey") % 777) / F.lit(1500.0)).alias("lat"))


_IN = "(lon >= {0} AND lon < {2} AND lat >= {1} AND lat < {3})"


@register(
    f"WITH {_CUSTOMER_POINTS} SELECT c_custkey, 'holed' AS zone FROM pts WHERE {_IN.format(2.0625, 48.6875, 2.25, 48.875)} AND NOT {_IN.format(2.125, 48.75, 2.1875, 48.8125)} "
    f"UNION ALL SELECT c_custkey, 'triangle' FROM pts WHERE lat >= 48.75 AND lat < 49.0 AND lon >= 2.25 + (lat - 48.75) / 2 AND lon < 2.5 - (lat - 48.75) / 2 "
    f"UNION ALL SELECT c_custkey, 'double' FROM pts WHERE {_IN.format(2.0, 49.0, 2.0625, 49.0625)} OR {_IN.format(2.125, 49.0, 2.15625, 49.03125)}"
)
def point_in_polygon(spark, d):
    return geo.points_in_zones(_customers(spark, d), _zones(spark)).select("c_custkey", "zone")


def _outlines(spark, d, per_side: int = 1):
    """Each nation's customers as a rectangle; sides have `per_side` points each, off the line by less than a metre."""
    n = standin.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    wide, high = F.lit(1 / 64.0), F.col("n") / F.lit(4096.0)
    x, y = F.lit(2.0) + F.col("c_nationkey") / F.lit(32.0), F.lit(48.5)
    steps = F.sequence(F.lit(0), F.lit(per_side - 1))
    off = lambda k: F.when(k % 2 == 1, F.lit(2e-6)).otherwise(0.0)
    side = lambda lon, lat: F.transform(steps, lambda k: F.struct(lon(k).alias("lon"), lat(k).alias("lat")))
    ring = F.concat(
        side(lambda k: x + wide * k / per_side, lambda k: y + off(k)), side(lambda k: x + wide + off(k), lambda k: y + high * k / per_side),
        side(lambda k: x + wide - wide * k / per_side, lambda k: y + high + off(k)), side(lambda k: x + off(k), lambda k: y + high - high * k / per_side), F.array(F.struct(x.alias("lon"), y.alias("lat"))),
    )
    return n.select(F.col("c_nationkey").cast("string").alias("zone"), F.array(F.array(ring)).alias("geometry"))


@register("SELECT c_nationkey::VARCHAR AS zone, round_even((2 + c_nationkey / 32.0 + 1 / 128.0)::DOUBLE * 1e5, 0) / 1e5 AS lon, round_even((48.5 + count(*) / 8192.0)::DOUBLE * 1e5, 0) / 1e5 AS lat, round_even((count(*) / 262144.0)::DOUBLE * 1e8, 0) / 1e8 AS area FROM customer GROUP BY c_nationkey")
def ring_area_centroid(spark, d):
    return geo.representative_points(_outlines(spark, d))


@register(f"WITH {_CUSTOMER_POINTS} SELECT c_custkey, lon BETWEEN 2.08 AND 2.32 AND lat BETWEEN 48.68 AND 48.92 AS inside FROM pts")
def bbox_filter(spark, d):
    return _customers(spark, d).select("c_custkey", filters.in_box(F.col("lon"), F.col("lat"), (2.1, 48.7, 2.3, 48.9), 0.02).alias("inside"))


_NEAR_SQL = f"""WITH {_CUSTOMER_POINTS}, {STATIONS_SQL}, near AS (
  SELECT c_custkey, station, sqrt(((p.lon - s.lon) * 111195.0 * cos(radians((p.lat + s.lat) / 2))) ** 2 + ((p.lat - s.lat) * 111195.0) ** 2) AS metres FROM pts p, stations s
), best AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY metres, station) AS k FROM near)"""


@register(f"{_NEAR_SQL} SELECT c_custkey, station, {q6('metres')}, greatest(1, ceil(metres / 64.0))::BIGINT AS minutes FROM best WHERE k = 1 AND ceil(metres / 64.0) <= 30")
def nearest_station(spark, d):
    return stations.nearest(_customers(spark, d), standin.stations(spark, d), "c_custkey").withColumn("metres", r6("metres"))


@register("SELECT s_suppkey, greatest(1, ceil(abs(s_acctbal) / 64.0))::BIGINT AS minutes FROM supplier")
def walk_minutes(spark, d):
    return standin.table(spark, d, "supplier").select("s_suppkey", sc.walk_minutes(F.abs("s_acctbal")).alias("minutes"))


def _records(spark, d):
    """Each supplier as two or three records of one place, some announced."""
    s = standin.stations(spark, d).withColumn("n", F.regexp_extract("station", r"(\d+)$", 1).cast("long"))
    copies = s.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") % 3).cast("int"))).alias("c"))
    line = lambda k: F.concat(F.lit("Line "), ((F.col("n") + k) % 7).cast("string"))
    return copies.select(
        F.when(F.col("c") == 1, F.upper("station")).otherwise(F.col("station")).alias("name"), (F.col("lon") + F.col("c") * 0.001).alias("lon"), "lat",
        F.when(F.col("c") == 0, "Metro").otherwise("RER").alias("network"), F.lit("station").alias("type"), F.when(F.col("c") == 2, "project").otherwise("service").alias("status"),
        F.array(line(0), line(1)).alias("lines"), F.array(line(2)).alias("planned"), (F.col("n") * 10 + F.col("c")).alias("ord"),
    )


def _flat(s: DataFrame) -> DataFrame:
    return s.select("name", "status", "network", F.array_join(F.array_sort("lines"), ",").alias("lines"), F.array_join(F.array_sort("planned"), ",").alias("planned"), "ord")


_MERGED_SQL = rf"""WITH {STATIONS_SQL}, s AS (SELECT *, regexp_extract(station, '(\d+)$', 1)::BIGINT AS n FROM stations),
m AS (SELECT n, CASE WHEN n % 3 = 0 THEN station ELSE upper(station) END AS name, 'service' AS status, CASE WHEN n % 3 = 0 THEN 'Metro' ELSE 'RER;Metro' END AS network, lon + CASE WHEN n % 3 = 0 THEN 0 ELSE 0.001 END AS lon, lat,
  'Line ' || least(n % 7, (n + 1) % 7) || ',Line ' || greatest(n % 7, (n + 1) % 7) AS lines, (n + 2) % 7 AS plan, n * 10 + CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS ord FROM s)"""


@register(f"{_MERGED_SQL} SELECT name, status, network, lines, 'Line ' || plan AS planned, ord FROM m")
def station_merge(spark, d):
    return _flat(stations.merged(_records(spark, d)))


@register(
    f"{_MERGED_SQL} SELECT name, status, network, lines, CASE WHEN EXISTS (SELECT 1 FROM m b WHERE b.n <> a.n AND a.plan IN (b.n % 7, (b.n + 1) % 7) "
    "AND sqrt(((a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2))) ** 2 + ((a.lat - b.lat) * 111320.0) ** 2) <= 150) THEN '' ELSE 'Line ' || plan END AS planned, ord FROM m a"
)
def station_reconcile(spark, d):
    with Scratch(spark) as scratch:
        found = scratch.result(stations.merged(_records(spark, d)))
    return _flat(stations.reconciled(found))


@register("SELECT c_nationkey::VARCHAR AS zone, 5 AS n_vertices, 81 AS n_before FROM customer GROUP BY c_nationkey")
def simplify_rings(spark, d):
    """Rectangles of 80 points, of which the corners are needed."""
    before = _outlines(spark, d, 20)
    after = geo.simplified(before, 8.0).select("zone", geo.vertex_count(F.col("geometry")).alias("n_vertices"))
    return after.join(before.select("zone", geo.vertex_count(F.col("geometry")).alias("n_before")), "zone")


@register("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'metro' WHEN 2 THEN 'tram' ELSE 'metro' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 2 ELSE 1 END AS rank FROM supplier")
def station_kind(spark, d):
    k = F.col("s_suppkey") % 4
    network = F.when(k == 0, "RER A").when(k == 1, "Métro").when(k == 2, "Tramway")
    type_ = F.when(k == 3, "light_rail").otherwise("station")
    return standin.table(spark, d, "supplier").select("s_suppkey", stations.kind(network, type_).alias("kind"), stations.rank(network, type_).alias("rank"))


# --- sources and sinks ------------------------------------------------------------------------


def _zipped(rows: DataFrame, parts: int) -> DataFrame:
    """(prefix, extension, content): zip archives of the rows as CSV, one of each part."""
    names = rows.columns

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("data.csv", frame[names].to_csv(index=False, sep="|"))
        return pd.DataFrame([("packed", "bin", out.getvalue())], columns=["prefix", "extension", "content"])

    return rows.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts))).groupBy("part").applyInPandas(pack, "prefix string, extension string, content binary")


@register("SELECT f.form, s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, s_acctbal::DECIMAL(18, 2)::VARCHAR AS s_acctbal FROM supplier, (VALUES ('gzip'), ('plain'), ('zip')) f(form)")
def unknown_tables(spark, d):
    """The suppliers, written in three packings with three separators and read back without saying which."""
    rows = standin.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("string").alias("s_nationkey"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("s_acctbal"))
    base = fresh_dir(spark, "unknown")
    rows.write.option("header", True).option("sep", ";").csv(f"{base}/plain")
    rows.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{base}/gzip")
    published.publish(_zipped(rows, 4), f"{base}/zip")
    out = None
    for form in ("plain", "gzip", "zip"):
        # the sink's manifest is no table, so archives are read by their names
        found = unknown.read_unknown(spark, f"{base}/{form}", suffixes=".bin" if form == "zip" else "").withColumn("form", F.lit(form))
        out = found if out is None else out.unionByName(found)
    return out.select("form", *rows.columns)


_CONTENTS_SQL = (
    "SELECT n.n_nationkey, string_agg(c_mktsegment || ';' || k || ';' || cents, chr(10) ORDER BY c_mktsegment) AS content FROM "
    "(SELECT c_nationkey AS n_nationkey, c_mktsegment, count(*) AS k, sum(round_even(c_acctbal * 100, 0)::BIGINT)::BIGINT AS cents FROM customer GROUP BY 1, 2) n GROUP BY 1"
)


@register(f"SELECT 'nation-' || n_nationkey || '-' || substr(sha256(content), 1, 16) || '.csv' AS name, 'nation-' || n_nationkey AS prefix, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM ({_CONTENTS_SQL})")
def published_files(spark, d):
    """A file of customer segments for each nation, named by its content; the manifest that the sink wrote."""
    cents = F.sum(sc.half_even(F.col("c_acctbal") * 100).cast("long"))
    lines = standin.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.concat_ws(";", "c_mktsegment", F.count("*").cast("string"), cents.cast("string")).alias("line"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("c_nationkey").agg(content.alias("content"))
    return published.publish(files.select(F.concat(F.lit("nation-"), "c_nationkey").alias("prefix"), F.lit("csv").alias("extension"), F.col("content").cast("binary").alias("content")), fresh_dir(spark, "published"))


# --- contours, boxes, units -------------------------------------------------------------------


def _contour_files(spark, d):
    """(prefix, extension, content): files of contours that overlap, of sections taken from customers."""
    held = standin.table(spark, d, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("commune"), F.col("c_nationkey").alias("n"), F.substring(F.rpad("c_mktsegment", 5, "X"), 1, 5).alias("letters")).distinct()
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.concat(F.lit("geo/00/"), "commune", F.lit("-sections")).alias("prefix")),
        F.struct(F.lit(1).alias("kind"), F.concat(F.lit("geo/b/cadastre-"), "commune", F.lit("-sections")).alias("prefix")),
        F.struct(F.lit(2).alias("kind"), F.concat(F.lit("geo/a/more-sections-"), "commune").alias("prefix")),
        F.struct(F.lit(3).alias("kind"), F.concat(F.lit("cache/"), "commune", F.lit("-sections")).alias("prefix")),
    ))
    rows = held.select("*", kinds.alias("f")).select("commune", "n", "letters", "f.*")
    there = (F.col("kind") == 0) & (F.col("n") % 3 == 0) | (F.col("kind") == 1) & (F.col("n") % 2 == 0) | (F.col("kind") == 2) & (F.col("n") % 4 == 0) | (F.col("kind") == 3) & (F.col("n") % 5 < 3)
    west = F.col("kind").cast("string")
    square = F.concat(F.lit('[[['), west, F.lit(',0],['), west, F.lit('.5,0],['), west, F.lit('.5,1],['), west, F.lit(',0]]]'))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"code":"'), F.substring("letters", 1, 2), F.lit('"},"geometry":{"type":"Polygon","coordinates":'), square, F.lit("}}"))
    content = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(feature)), ","), F.lit("]}"))
    broken = (F.col("kind") == 0) & (F.col("n") % 7 == 0)
    files = rows.where(there).groupBy("commune", "n", "kind", "prefix").agg(content.alias("content"))
    return files.select("prefix", F.when(F.col("kind") == 2, "json").otherwise("geojson").alias("extension"), F.when(broken, F.lit('{"type": "Feat')).otherwise(F.col("content")).cast("binary").alias("content"))


_CONTOUR_SQL = """WITH held AS (SELECT DISTINCT c_nationkey AS n, lpad(c_nationkey::VARCHAR, 5, '0') AS commune, substr(c_mktsegment, 1, 2) AS letters FROM customer),
chosen AS (SELECT *, CASE WHEN n % 3 = 0 AND n % 7 <> 0 THEN 0 WHEN n % 4 = 0 THEN 2 WHEN n % 2 = 0 THEN 1 WHEN n % 5 < 3 THEN 3 END AS kind FROM held)"""
_FILE_SQL = "CASE kind WHEN 0 THEN 'local (' || commune || '-sections.geojson)' WHEN 1 THEN 'local (cadastre-' || commune || '-sections.geojson)' WHEN 2 THEN 'local (more-sections-' || commune || '.json)' WHEN 3 THEN 'cache (' || commune || '-sections.geojson)' END"


def _contours(spark, d):
    base = fresh_dir(spark, "contours")
    published.publish(_contour_files(spark, d), base, named_by="prefix")
    c = standin.table(spark, d, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("commune"), F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("000"), F.substring("c_mktsegment", 1, 2)).alias("section"))
    return c, contours.load(spark, f"{base}/geo", c, c.where("section NOT LIKE '%BU'"), f"{base}/cache")


@register(f"{_CONTOUR_SQL} SELECT commune || '000' || letters AS zone, commune, kind::DOUBLE AS west, {_FILE_SQL} AS source FROM chosen WHERE kind IS NOT NULL AND letters <> 'BU'")
def contour_precedence(spark, d):
    _, found = _contours(spark, d)
    return found.zones.select("zone", "commune", F.col("geometry")[0][0][0]["lon"].alias("west"), "source")


@register(f"{_CONTOUR_SQL} SELECT DISTINCT commune, {_FILE_SQL} AS source FROM chosen")
def contour_sources(spark, d):
    return _contours(spark, d)[1].sources


@register(f"{_CONTOUR_SQL} SELECT commune || '000' || letters AS section FROM chosen WHERE kind IS NULL OR letters = 'BU'")
def contours_missing(spark, d):
    c, found = _contours(spark, d)
    return contours.without_contour(c, found.zones)


def _boxes(spark, d, n: str = "s_suppkey"):
    s = standin.table(spark, d, "supplier").select(F.col(n).cast("long").alias("box"))
    size = F.pow(F.lit(2.0), -(F.col("box") * 7 % 6)) / 8
    west, south = F.lit(2.0) + (F.col("box") * 37 % 64) / F.lit(256.0), F.lit(48.5) + (F.col("box") * 53 % 48) / F.lit(128.0)
    return s.select("box", west.alias("west"), south.alias("south"), (west + size).alias("east"), (south + size * F.when(F.col("box") % 3 == 0, 1.5).otherwise(0.75)).alias("north"))


_BOXES_SQL = """WITH k AS (SELECT s_suppkey AS box, 2.0::DOUBLE ** (-(s_suppkey * 7 % 6)) / 8 AS size, 2.0::DOUBLE + (s_suppkey * 37 % 64) / 256.0::DOUBLE AS west, 48.5::DOUBLE + (s_suppkey * 53 % 48) / 128.0::DOUBLE AS south FROM supplier),
boxes AS (SELECT box, west, south, west + size AS east, south + size * CASE WHEN box % 3 = 0 THEN 1.5 ELSE 0.75 END::DOUBLE AS north FROM k)"""


@register(f"{_BOXES_SQL} SELECT box FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.box > a.box AND b.west <= a.west AND b.south <= a.south AND a.east <= b.east AND a.north <= b.north)")
def boxes_absorbed(spark, d):
    return boxes.absorbed(_boxes(spark, d)).select("box")


@register(f"{_BOXES_SQL} SELECT box, EXISTS (SELECT 1 FROM boxes b WHERE b.box % 4 = 1 AND b.west - 0.01::DOUBLE <= a.west AND b.south - 0.01::DOUBLE <= a.south AND a.east <= b.east + 0.01::DOUBLE AND a.north <= b.north + 0.01::DOUBLE) AS covered FROM boxes a WHERE box % 4 <> 1")
def boxes_covered(spark, d):
    b = _boxes(spark, d)
    return boxes.covered(b.where("box % 4 <> 1"), b.where("box % 4 = 1"))


@register(
    "WITH pairs AS (SELECT DISTINCT lpad(c_nationkey::VARCHAR, 5, '0') AS parent, lpad(c_nationkey::VARCHAR, 2, '0') || substr(c_mktsegment, 1, 3) AS commune FROM customer WHERE c_nationkey % 3 = 0), "
    "members AS (SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS parent, n_regionkey FROM nation), "
    "grown AS (SELECT n_regionkey, coalesce(p.commune, m.parent) AS commune FROM members m LEFT JOIN pairs p ON p.parent = m.parent) "
    "SELECT lpad(n_regionkey::VARCHAR, 5, '0') AS unit, commune FROM grown WHERE commune NOT LIKE '%MAC' AND commune <> '00001'"
)
def urban_units(spark, d):
    """Regions as units: a third of the nations are known by their customers' segments only."""
    n = standin.table(spark, d, "nation")
    pairs = standin.table(spark, d, "customer").where("c_nationkey % 3 = 0").select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("parent"), F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.substring("c_mktsegment", 1, 3)).alias("commune")).distinct()
    known = pairs.select("commune").unionByName(n.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("commune"))).where("commune NOT LIKE '%MAC' AND commune <> '00001'")
    table = n.select(F.col("n_regionkey").alias("CODE_UU"), F.concat(F.lit(" "), "n_nationkey").alias("COM"))
    out = None
    for unit in range(5):
        code = f"{unit:05d}"
        found = units.in_unit(table, code, known, pairs).select(F.lit(code).alias("unit"), "commune")
        out = found if out is None else out.unionByName(found)
    return out


# --- stations of boxes ------------------------------------------------------------------------

_REFRESH_BOXES = ((0, 2.0, 48.6, 2.25, 48.9, True, True), (1, 2.2, 48.6, 2.5, 48.95, True, True), (2, 2.0, 48.85, 2.5, 49.2, True, False), (3, 2.1, 48.7, 2.15, 48.75, False, True))


def _refreshed(spark, d):
    """Suppliers as stations; the second box's answer lacks a third of them, the third's has no plans, the fourth gave none."""
    s = standin.stations(spark, d).withColumn("n", F.regexp_extract("station", r"(\d+)$", 1).cast("long"))
    none = F.array().cast("array<string>")
    record = lambda status, planned: (F.col("station").alias("name"), "lon", "lat", F.lit("Metro").alias("network"), F.lit("station").alias("type"), status.alias("status"), F.array(F.concat(F.lit("L"), F.col("n").cast("string"))).alias("lines"), planned.alias("planned"), F.col("n").alias("ord"))
    known = s.where("n % 11 <> 5").select(*record(F.when(F.col("n") % 6 == 0, "project").otherwise("service"), F.when(F.col("n") % 10 == 1, F.array(F.concat(F.lit("P"), F.col("n").cast("string")))).otherwise(none)))
    rows = spark.createDataFrame(_REFRESH_BOXES, "box long, west double, south double, east double, north double, answered boolean, plans_answered boolean")
    met = boxes.holding(s, rows, "station").join(s, "station").where("box <> 3")
    lost = F.when(F.col("box") == 1, F.col("n") % 3 == 0).otherwise(F.col("n") % 40 == F.col("box"))
    fresh = met.where(~lost & ~((F.col("box") == 2) & (F.col("n") % 6 == 0) & (F.col("n") % 12 != 0))).select(*record(F.when((F.col("n") % 12 == 6), "project").otherwise("service"), none), "box")
    return stations.refresh(known, fresh, rows)


_REFRESH_SQL = rf"""WITH {STATIONS_SQL}, s AS (SELECT *, regexp_extract(station, '(\d+)$', 1)::BIGINT AS n FROM stations),
inside AS (SELECT *, {", ".join(f"(lon BETWEEN {w} AND {e} AND lat BETWEEN {so} AND {no}) AS b{k}" for k, w, so, e, no, *_ in _REFRESH_BOXES)} FROM s),
k AS (SELECT * FROM inside WHERE n % 11 <> 5),
f0 AS (SELECT *, n % 12 = 6 AS plan FROM inside WHERE b0 AND n % 40 <> 0), f1 AS (SELECT *, n % 12 = 6 AS plan FROM inside WHERE b1 AND n % 3 <> 0), f2 AS (SELECT *, false AS plan FROM inside WHERE b2 AND n % 40 <> 2 AND NOT (n % 6 = 0 AND n % 12 <> 0)),
d0 AS (SELECT *, after >= 0.9 * before AS ok FROM (SELECT count(*) AS before, (SELECT count(*) FROM f0 WHERE NOT plan) AS after FROM k WHERE b0 AND n % 6 <> 0)),
n0 AS (SELECT station, lon, lat, n, b0, b1, b2, b3, CASE WHEN n % 6 = 0 THEN 'project' ELSE 'service' END AS status, n % 6 <> 0 AND n % 10 = 1 AS more FROM k WHERE NOT (b0 AND (SELECT ok FROM d0))
  UNION ALL SELECT station, lon, lat, n, b0, b1, b2, b3, CASE WHEN plan THEN 'project' ELSE 'service' END, false FROM f0 WHERE (SELECT ok FROM d0)),
d1 AS (SELECT *, after >= 0.9 * before AS ok FROM (SELECT count(*) AS before, (SELECT count(*) FROM f1 WHERE NOT plan) AS after FROM n0 WHERE b1 AND status = 'service')),
n1 AS (SELECT * FROM n0 WHERE NOT (b1 AND (SELECT ok FROM d1)) UNION ALL SELECT station, lon, lat, n, b0, b1, b2, b3, CASE WHEN plan THEN 'project' ELSE 'service' END, false FROM f1 WHERE (SELECT ok FROM d1)),
d2 AS (SELECT *, after >= 0.9 * before AS ok FROM (SELECT count(*) AS before, (SELECT count(*) FROM f2) AS after FROM n1 WHERE b2 AND status = 'service')),
n2 AS (SELECT station, n, status, more FROM n1 WHERE NOT (b2 AND (SELECT ok FROM d2)) UNION ALL SELECT station, n, 'service', false FROM f2 WHERE (SELECT ok FROM d2)
  UNION ALL SELECT station, n, CASE WHEN status = 'service' THEN 'works' ELSE status END, true FROM n1 WHERE b2 AND (SELECT ok FROM d2) AND (more OR status <> 'service'))"""


@register(
    f"{_REFRESH_SQL} SELECT 0::BIGINT AS box, before, after, ok AS accepted FROM d0 UNION ALL SELECT 1, before, after, ok FROM d1 UNION ALL SELECT 2, before, after, ok FROM d2 "
    "UNION ALL SELECT 3, (SELECT count(*) FROM n1 WHERE b3 AND status = 'service' AND NOT (b2 AND (SELECT ok FROM d2))) + (SELECT count(*) FROM f2 WHERE b3 AND (SELECT ok FROM d2)), 0, false"
)
def station_refresh_decisions(spark, d):
    return _refreshed(spark, d).decisions


@register(f"{_REFRESH_SQL} SELECT station AS name, min(CASE status WHEN 'service' THEN 0 WHEN 'works' THEN 1 ELSE 2 END)::INT AS status FROM n2 GROUP BY station")
def station_refresh(spark, d):
    network = _refreshed(spark, d).network
    return network.select("name", F.when(F.col("status") == "service", 0).when(F.col("status") == "works", 1).otherwise(2).alias("status"))


_CITED_SQL = rf"""WITH {_CUSTOMER_POINTS}, {STATIONS_SQL}, s AS (SELECT *, regexp_extract(station, '(\d+)$', 1)::BIGINT AS n FROM stations), kinds AS (SELECT *, n % 3 <> 0 AS runs, n % 3 = 0 OR n % 7 = 0 AS planned, CASE WHEN n % 5 = 1 THEN 2 ELSE 1 END AS rank FROM s),
near AS (SELECT c_custkey, station, runs, planned, rank, sqrt(((p.lon - k.lon) * 111195.0 * cos(radians((p.lat + k.lat) / 2))) ** 2 + ((p.lat - k.lat) * 111195.0) ** 2) AS metres FROM (SELECT c_custkey, lon, lat + 11 AS lat FROM pts) p, (SELECT * REPLACE (lat + 11 AS lat) FROM kinds) k),
within AS (SELECT *, greatest(1, ceil(metres / 64.0))::BIGINT AS minutes FROM near WHERE ceil(metres / 64.0) <= 30),
best AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, role ORDER BY metres, station) AS k FROM (SELECT *, 'service' AS role FROM within WHERE runs UNION ALL SELECT *, 'project' FROM within WHERE planned UNION ALL SELECT *, 'train' FROM within WHERE runs AND rank = 2)),
first AS (SELECT * FROM best WHERE k = 1)
SELECT f.c_custkey, f.role, f.station, {R6.format("f.metres")} AS metres, f.minutes FROM first f LEFT JOIN first s ON s.c_custkey = f.c_custkey AND s.role = 'service'
WHERE f.role = 'service' OR (f.role = 'project' AND (s.metres IS NULL OR f.metres < s.metres)) OR (f.role = 'train' AND s.rank <> 2)"""


@register(_CITED_SQL)
def stations_cited(spark, d):
    """At 60 degrees north, where a degree of longitude is half as wide."""
    n = F.regexp_extract("station", r"(\d+)$", 1).cast("long")
    s = standin.stations(spark, d).select("station", "lon", (F.col("lat") + 11).alias("lat"), F.when(n % 3 != 0, "service").otherwise("project").alias("status"), F.when(n % 7 == 0, F.array(F.lit("x"))).alias("planned"), F.when(n % 5 == 1, 2).otherwise(1).alias("rank"))
    return stations.cited(_customers(spark, d).withColumn("lat", F.col("lat") + 11), s, "c_custkey").withColumn("metres", r6("metres"))


# --- from files to sales ----------------------------------------------------------------------

_FILE_SALES = "sale_id, sale_date, year, nature, price, n_prices, commune, commune_name, section, parcel, area, private_area, rooms, n_premises, n_repeats, n_outbuildings, has_activity, premise_types, property_type, lon, lat"


def _back(x: str, names: dict[str, str]):
    return files.named(F.col(x), {name: source for source, name in names.items()})


def _source_files(spark, d) -> str:
    """The stand-in's lines as the source publishes them: CSV texts with its names, decimal commas and markers of missing values.

    The order in a file counts among repeated lines, so a sale's lines are in one file, by `ord`.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    n = standin.lines(spark, d).repartition("sale_id").sortWithinPartitions("sale_id", "ord")
    kind = F.when(F.col("premise_type") == "Outbuilding", F.when(F.col("sale_id") % 2 == 0, "Dépendance").otherwise("DÉPENDANCE")).otherwise(_back("premise_type", files.PREMISES))
    rows = n.select(
        text("sale_id").alias(" ID_mutation "), text("sale_date").alias("date_mutation"), F.concat(_back("nature", files.NATURES), F.lit(" ")).alias("nature_mutation"), F.replace(text("price"), F.lit("."), F.lit(",")).alias("valeur_fonciere"),
        F.regexp_replace("commune", "^0+(?=.)", "").alias("code_commune"), "commune_name", kind.alias("type_local"), text("area").alias("surface_reelle_bati"), text("private_area").alias("lot2_surface_carrez"),
        text("rooms").alias("nombre_pieces_principales"), F.col("parcel").alias("id_parcelle"), text("lon").alias("longitude"), text("lat").alias("latitude"),
    ).withColumnRenamed("commune_name", "nom_commune")
    path = fresh_dir(spark, "source")
    rows.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return path


@register(f"{WITH_SALES} SELECT {_FILE_SALES.replace('sale_id,', 'sale_id::VARCHAR AS sale_id,', 1).replace(', parcel,', ',').replace(', lon, lat', '')}, {q6('lon')}, {q6('lat')} FROM sales")
def file_to_sales(spark, d):
    """Lines written as source files, read back, typed and put together again."""
    lines = files.typed_lines(files.read_lines(spark, _source_files(spark, d)))
    return reconstruct.reconstruct(lines).select(*(c for c in _FILE_SALES.split(", ") if c not in ("parcel", "lon", "lat")), r6("lon"), r6("lat"))


@register(f"{WITH_SALES} SELECT sale_id::VARCHAR AS sale_id, count(*) AS n_lines, sum(round_even(price * 100, 0)::BIGINT)::BIGINT AS cents, count(area) AS n_areas FROM lines WHERE commune IN (SELECT lpad(n_nationkey::VARCHAR, 5, '0') FROM nation WHERE n_regionkey = 1) GROUP BY sale_id")
def file_lines_of_perimeter(spark, d):
    """Lines of the communes of one region, read from source files."""
    codes = fresh_dir(spark, "codes")
    standin.table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 5, "0"), F.lit("\t# "), "n_name").alias("value")).write.text(codes)
    lines = files.typed_lines(files.read_lines(spark, _source_files(spark, d)), files.read_codes(spark, codes))
    return lines.groupBy("sale_id").agg(F.count("*").alias("n_lines"), F.sum(sc.half_even(F.col("price") * 100).cast("long")).alias("cents"), F.count("area").alias("n_areas"))


@register(f"{WITH_CLEAN}, asked AS (SELECT sale_date, commune, address FROM clean WHERE sale_id % 40 = 3) SELECT sale_id FROM clean WHERE (sale_date, commune, lower(address)) NOT IN (SELECT sale_date, commune, lower(address) FROM asked)")
def removals_from_file(spark, d):
    """Sales without those that a list of removals names."""
    s, path = standin.clean(spark, d), fresh_dir(spark, "removals")
    s.where("sale_id % 40 = 3").select(F.concat_ws(";", F.col("sale_date").cast("string"), "commune", F.concat(F.lit(" "), F.upper("address"))).alias("value")).write.text(path)
    return filters.without_removed(s, files.read_removals(spark, path)).select("sale_id")


@register(f"{WITH_CLEAN} SELECT commune, count(*) AS n, sum(round_even(price * 100, 0)::BIGINT)::BIGINT AS cents FROM clean GROUP BY commune")
def frozen_sales(spark, d):
    """Clean sales frozen to parquet with their counters and read back by column."""
    path = fresh_dir(spark, "frozen")
    files.write_sales(standin.clean(spark, d), path, {"source": "stand-in"})
    return files.read_sales(spark, path, ["commune", "price", "no such column"]).groupBy("commune").agg(F.count("*").alias("n"), F.sum(sc.half_even(F.col("price") * 100).cast("long")).alias("cents"))


# --- complete layers --------------------------------------------------------------------------


def _layer(spark, d, key: str, **options):
    """A complete layer; its parts read one written table."""
    with Scratch(spark) as scratch:
        s = scratch.written(standin.clean(spark, d).select("sale_id", "ord", "sale_date", "year", "section", "commune", "commune_name", "address", "property_type", "price", "area", "price_m2"))
        found = layers.layer(s, key, titles=zones.labels(s, key), streets=zones.main_streets(s, key), words=layers.Words(key), **options)
        return layers.Layer(*(scratch.result(x) for x in (found.rows, found.legend, found.summary, found.scale)))


_LAYER_SQL = f"{_STATS_SQL}{_SCALE_SQL}, {_STREETS_SQL}, names AS (SELECT section, min(commune_name) AS commune_name, max(price) AS max_price, min(price) AS min_price FROM clean GROUP BY section)"


@register(
    f"{_LAYER_SQL} SELECT s.zone, CASE WHEN n_sales <= 4 THEN '{sc.GREY}' ELSE {_ZONE_COLOUR} END AS colour, commune_name || ' ' || s.zone AS title, streets, "
    "CASE WHEN n_sales <= 4 THEN 'Too few sales to stand for their place: section in grey' END AS note, n_sales, median_m2, mean_m2, median_price, mean_price, median_area, max_price, min_price "
    "FROM stats s JOIN names ON s.zone = names.section LEFT JOIN streets ON s.zone = streets.zone, scale"
)
def complete_layer_price(spark, d):
    return _layer(spark, d, "section").rows


@register(
    f"{_STATS_SQL} SELECT replace(format('{{:,}}', sum(n_sales)::BIGINT), ',', ' ') || ' sales in ' || count(*) || ' sections' || CASE WHEN count(*) FILTER (n_sales <= 4) > 0 THEN ', ' || count(*) FILTER (n_sales <= 4) || ' of them grey for lack of sales.' ELSE '.' END AS summary FROM stats"
)
def layer_summary_price(spark, d):
    return _layer(spark, d, "section").summary


_STATS_COMMUNE = _zone_sql("commune").split(" SELECT commune AS zone", 1)[1]


@register(
    _trend_sql("commune") + f", {_AMPLITUDE_SQL}, stats AS (SELECT commune AS zone{_STATS_COMMUNE}), names AS (SELECT commune, max(price) AS max_price, min(price) AS min_price FROM clean GROUP BY commune) "
    f"SELECT s.zone, {_colour_sql('CASE WHEN reliable THEN (rate + amplitude) / (2 * amplitude) END', sc.TREND_PALETTE)} AS colour, CASE WHEN coalesce(reliable, false) THEN NULL ELSE 'No trend: it takes 3 years of 5 sales' END AS note, "
    "s.n_sales, median_m2, max_price, min_price, CASE WHEN reliable THEN rate END AS rate, CASE WHEN reliable THEN \"change\" END AS change, CASE WHEN reliable THEN r2 END AS r2, n_years::DOUBLE AS n_years "
    "FROM stats s JOIN names ON s.zone = names.commune LEFT JOIN trend ON s.zone = trend.zone, amp"
)
def complete_layer_trend(spark, d):
    rows = _layer(spark, d, "commune", with_trend=True).rows
    return rows.select("zone", "colour", "note", "n_sales", "median_m2", "max_price", "min_price", r6("rate"), r6("change"), r6("r2"), F.col("n_years").cast("double").alias("n_years"))


@register(f"{_STATS_SQL.replace('SELECT section AS zone', 'SELECT commune AS zone').replace('WHERE section IS NOT NULL GROUP BY section', 'WHERE commune IS NOT NULL GROUP BY commune')}{_SCALE_SQL} SELECT {q6('low')}, {q6('high')}, empty, '{'|'.join(sc.PRICE_PALETTE)}' AS palette, 'm2' AS \"column\" FROM scale")
def layer_scale_in_trend_mode(spark, d):
    """Single sales keep the scale of prices where zones show their trend."""
    return _texts(_layer(spark, d, "commune", with_trend=True).scale.withColumns({"low": r6("low"), "high": r6("high")}), "palette")


@register(
    f"{WITH_CLEAN}, f AS (SELECT quantile_cont(lon, 0.01) AS west, quantile_cont(lat, 0.01) AS south, quantile_cont(lon, 0.99) AS east, quantile_cont(lat, 0.99) AS north FROM clean WHERE lon BETWEEN 2.0 AND 2.5 AND lat BETWEEN 48.6 AND 49.2) "
    f"SELECT {q6('round_even(west * 1e6, 0) / 1e6 - 0.6::DOUBLE', 'west')}, {q6('round_even(south * 1e6, 0) / 1e6 - 0.3::DOUBLE', 'south')}, {q6('round_even(east * 1e6, 0) / 1e6 + 0.6::DOUBLE', 'east')}, {q6('round_even(north * 1e6, 0) / 1e6 + 0.3::DOUBLE', 'north')} FROM f"
)
def navigation_limits(spark, d):
    return layers.navigation_limits(zones.opening_frame(standin.clean(spark, d), BOX)).select(r6("west"), r6("south"), r6("east"), r6("north"))


# --- search and labels ------------------------------------------------------------------------


@register(
    "WITH names AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN left(p_name, 6) WHEN 2 THEN substr(p_name, 3, 4) ELSE '  ' || replace(left(p_name, 9), ' ', '--') END AS asked FROM part WHERE p_partkey % 20 = 0 OR p_partkey % 20 = 5 OR p_partkey % 20 = 10 OR p_partkey % 20 = 15), "
    "k AS (SELECT p_partkey, trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')) AS asked FROM q), n AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM names), "
    "met AS (SELECT p_partkey, name, CASE WHEN key = asked THEN 0 WHEN starts_with(key, asked) THEN 1 ELSE 2 END AS rank FROM k JOIN n ON contains(key, asked) WHERE asked <> '') "
    "SELECT p_partkey, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, name) AS i FROM met) WHERE i = 1"
)
def place_search(spark, d):
    """Parts of part names, typed with other case and marks, against all names."""
    p, n = standin.table(spark, d, "part"), F.col("p_name")
    kind = F.col("p_partkey") % 4
    asked = F.when(kind == 0, F.upper(n)).when(kind == 1, F.substring(n, 1, 6)).when(kind == 2, F.substring(n, 3, 4)).otherwise(F.concat(F.lit("  "), F.replace(F.substring(n, 1, 9), F.lit(" "), F.lit("--"))))
    return search.find(p.where("p_partkey % 5 = 0").select("p_partkey", asked.alias("text")), search.index(p, "p_name"), "p_partkey")


def _commune_squares(spark, d):
    """Each nation as two squares whose size follows its customers."""
    n = standin.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    side, x, y = F.sqrt(F.col("n").cast("double")) / 64, F.col("c_nationkey").cast("double"), F.lit(40.0)
    point = lambda a, b: F.array(a, b)
    square = lambda a, b, s: F.array(F.array(point(a, b), point(a + s, b), point(a + s, b + s), point(a, b + s), point(a, b)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(square(x, y, side / 2), square(x, y + 2, side)).alias("coordinates"))
    code = F.when(F.col("c_nationkey") % 3 == 0, F.struct(F.lit(None).cast("string").alias("code_commune"), F.lit(None).cast("string").alias("commune"), F.col("c_nationkey").cast("string").alias("id")))
    code = code.otherwise(F.struct(F.when(F.col("c_nationkey") % 3 == 1, F.lpad(F.col("c_nationkey").cast("string"), 5, "0")).alias("code_commune"), F.col("c_nationkey").cast("string").alias("commune"), F.lit("x").alias("id")))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), code.alias("properties"), geometry.alias("geometry")))
    content = F.concat(F.lit('{"type":"FeatureCollection",\n"features":[\n'), F.array_join(F.array_sort(F.collect_list(feature)), ",\n"), F.lit("\n]}\n"))
    base = fresh_dir(spark, "communes")
    published.publish(n.groupBy((F.col("c_nationkey") % 4).cast("string").alias("prefix")).agg(F.lit("geojson").alias("extension"), content.cast("binary").alias("content")), base, named_by="prefix")
    return files.read_commune_contours(spark, f"{base}/*.geojson")


_SQUARES_SQL = "WITH n AS (SELECT c_nationkey AS n, sqrt(count(*)::DOUBLE) / 64 AS side FROM customer GROUP BY 1)"


@register(f"{_SQUARES_SQL} SELECT n_name AS name, round_even((n + side / 2) * 1e5, 0) / 1e5 AS lon, round_even((42 + side / 2) * 1e5, 0) / 1e5 AS lat, {q6('side * side', 'weight')} FROM n JOIN nation ON n = n_nationkey WHERE n > 0")
def map_labels(spark, d):
    names = standin.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zone"), F.concat("n_name", F.lit("  Arrondissement")).alias("name"))
    return geo.map_labels(_commune_squares(spark, d), names).withColumn("weight", r6("weight"))


@register(f"{_SQUARES_SQL}, p AS (SELECT n, unnest([side * side / 4, side * side]) AS area, unnest([n + side / 4, n + side / 2]) AS lon, unnest([40 + side / 4, 42 + side / 2]) AS lat FROM n WHERE n > 0) SELECT lpad(n::VARCHAR, 5, '0') AS commune, {q6('sum(lon * area) / sum(area)', 'lon')}, {q6('sum(lat * area) / sum(area)', 'lat')}, {q6('sum(area)', 'area')} FROM p GROUP BY n")
def anchors_of_parts(spark, d):
    found = geo.anchors_of_parts(_commune_squares(spark, d).withColumnRenamed("zone", "commune"))
    return found.select("commune", r6("lon"), r6("lat"), r6("area"))


@register(f"{_SQUARES_SQL} SELECT lpad(n::VARCHAR, 5, '0') AS zone, lpad(n::VARCHAR, 5, '0') AS c, 'MultiPolygon' AS kind, 10 AS vertices FROM n WHERE n > 0")
def map_contours(spark, d):
    found = geo.map_contours(_commune_squares(spark, d), 8.0)
    part = lambda path: F.get_json_object("feature", path)
    size = F.aggregate(F.from_json(part("$.geometry.coordinates"), "array<array<array<array<double>>>>"), F.lit(0), lambda s, p: s + F.size(p[0]))
    return found.select("zone", part("$.properties.c").alias("c"), part("$.geometry.type").alias("kind"), size.alias("vertices"))


@register(f"WITH {STATIONS_SQL}, s AS (SELECT *, regexp_extract(station, '(\\d+)$', 1)::BIGINT AS n FROM stations) SELECT station AS name, CASE WHEN n % 2 = 0 THEN 'Metro' ELSE 'RER' END AS network, 'L' || n % 7 || ', L' || (n + 1) % 7 AS lines, CASE WHEN n % 3 = 0 THEN 'P' ELSE '' END AS planned, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END AS rank, CASE WHEN n % 2 = 0 THEN 'metro' ELSE 'train' END AS kind FROM s WHERE n % 10 <> 4")
def station_points(spark, d):
    """Stations written as a network file, read back, and shown as points."""
    s = standin.stations(spark, d).withColumn("n", F.regexp_extract("station", r"(\d+)$", 1).cast("long"))
    line = lambda k: F.concat(F.lit("L"), ((F.col("n") + k) % 7).cast("string"))
    rows = s.select(
        F.col("station").alias("name"), "lon", "lat", F.when(F.col("n") % 2 == 0, "Metro").otherwise("RER").alias("network"), F.when(F.col("n") % 20 == 4, "bus").otherwise("station").alias("type"), F.lit("service").alias("status"),
        F.array(line(0), line(1)).alias("lines"), F.when(F.col("n") % 3 == 0, F.array(F.lit("P"))).alias("planned"), F.col("n").alias("ord"), F.when(F.col("n") % 20 == 14, "industrial").alias("usage"),
    )
    path = fresh_dir(spark, "network")
    files.write_network(stations.for_passengers(rows).drop("usage"), path)
    found = stations.as_points(files.read_network(spark, path))
    part = lambda n: F.get_json_object("feature", f"$.properties.{n}").alias(n)
    return found.select("name", part("network"), part("lines"), part("planned"), part("rank").cast("int").alias("rank"), part("kind"))
