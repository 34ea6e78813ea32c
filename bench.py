"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from arpent import catalogue
from arpent.operators import trend, zones
from arpent.operators.filters import SaleFilter
from arpent.plans import standin
from arpent.session import build_session
from arpent.sources.stores import Scratch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("sale_reconstruct", "quality_rejects", "zone_stats_commune", "zone_stats_section", "zone_stats_two_grains", "zone_extremes", "trend_section", "layer_price", "vintage_guardrails", "tile_locations", "nearest_station", "point_in_polygon")


def frozen(spark) -> dict[str, float]:
    """Freezing clean sales once, and what a change of a filter computes again from them."""
    times = {}

    def timed(name, run):
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    with Scratch(spark) as scratch:
        kept = []
        timed("freeze_sales", lambda: kept.append(scratch.written(standin.clean(spark, SF_DIR))))
        some = SaleFilter(area_min=20.0, types=("Apartment", "House")).apply(kept[0])
        noop = lambda df: df.write.format("noop").mode("overwrite").save()
        for name, query in (("recompute_two_grains", zones.statistics_of_both), ("recompute_section", lambda s: zones.statistics(s, "section")), ("recompute_trend", lambda s: trend.trend(s, "section"))):
            noop(query(some))  # compiles, as the other queries have been
            timed(name, lambda: noop(query(some)))  # noqa: B023
    return times


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["zone_stats_commune"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles and warms up
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    total = round(sum(times.values()), 3)  # of the headline queries, which start from raw lines
    times |= frozen(spark)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
