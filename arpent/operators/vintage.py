"""Comparison of two vintages of the sales, with guard-rails."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How much a refresh may lose before someone has to look at it.
SALES_DROP, YEAR_DROP, PRICE_SHIFT, COMMUNES_LOST, WITHOUT_CONTOUR = 0.30, 0.10, 0.05, 3, 0.005


def same_period(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides within the dates that both cover."""
    span = lambda d, a, b: d.agg(F.min("sale_date").alias(a), F.max("sale_date").alias(b))
    both = span(old, "a0", "a1").crossJoin(span(new, "b0", "b1")).select(F.greatest("a0", "b0").alias("from_"), F.least("a1", "b1").alias("to_"))
    cut = lambda d: d.crossJoin(F.broadcast(both)).where(F.col("sale_date").between(F.col("from_"), F.col("to_"))).drop("from_", "to_")
    return cut(old), cut(new)


def compare(old: DataFrame, new: DataFrame, key: str, what=None) -> DataFrame:
    """(key, before, after) of both sides, 0 or NULL where one side lacks the key."""
    measure = F.count("*") if what is None else what
    a = old.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("before"))
    b = new.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("after"))
    out = a.join(b, key, "full")
    return out.fillna(0, ["before", "after"]) if what is None else out


def commune_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    gone = old.select("commune").distinct().join(new.select("commune").distinct(), "commune", "left_anti").withColumn("change", F.lit("gone"))
    come = new.select("commune").distinct().join(old.select("commune").distinct(), "commune", "left_anti").withColumn("change", F.lit("come"))
    return gone.unionByName(come)


def orphans(sales: DataFrame, contours: DataFrame) -> DataFrame:
    """Sales by section that has no contour."""
    return sales.where(F.col("section").isNotNull()).join(contours.select("section").distinct(), "section", "left_anti").groupBy("section").agg(F.count("*").alias("n"))


def guard_rails(old: DataFrame, new: DataFrame, contours: DataFrame | None = None, department: str = "department") -> DataFrame:
    """(rule, subject, before, after) for each rule that the refresh breaks.

    Counts by year, commune and day are made once for both sides and shared by all rules but the
    median, which needs the prices.
    """
    side = lambda d, k: d.select(F.lit(k).alias("side"), "year", "commune", "sale_date", "price_m2", F.col(department).alias("department"))
    both = side(old, 0).unionByName(side(new, 1))
    counts = both.groupBy("side", "year", "commune", "sale_date").agg(F.count("*").alias("n"))
    of = lambda k, what: F.sum(F.when(F.col("side") == k, what))
    facts = counts.agg(*(F.coalesce(of(k, F.col("n")), F.lit(0)).cast("double").alias(c) for k, c in ((0, "before"), (1, "after"))))
    parts = [facts.where(F.col("after") < (1 - SALES_DROP) * F.col("before")).select(F.lit("total").alias("rule"), F.lit("all").alias("subject"), "before", "after")]
    ends = [f(F.when(F.col("side") == k, F.col("sale_date"))) for k in (0, 1) for f in (F.min, F.max)]
    span = counts.agg(F.greatest(ends[0], ends[2]).alias("from_"), F.least(ends[1], ends[3]).alias("to_"))  # one row
    inside = lambda d: d.crossJoin(F.broadcast(span)).where(F.col("sale_date").between(F.col("from_"), F.col("to_")))
    years = inside(counts).where("year IS NOT NULL").groupBy("year").agg(*(F.coalesce(of(k, F.col("n")), F.lit(0)).alias(c) for k, c in ((0, "before"), (1, "after"))))
    years = years.where("before > 0").where(F.col("after") < (1 - YEAR_DROP) * F.col("before"))
    parts.append(years.select(F.lit("year"), F.col("year").cast("string"), F.col("before").cast("double"), F.col("after").cast("double")))
    price = lambda k: F.median(F.when(F.col("side") == k, F.col("price_m2")))
    shift = inside(both).where("department IS NOT NULL").groupBy("department").agg(price(0).alias("before"), price(1).alias("after"))
    shift = shift.where(F.abs(F.try_divide("after", "before") - 1) > PRICE_SHIFT)
    parts.append(shift.select(F.lit("median price"), F.col("department").cast("string"), "before", "after"))
    gone = counts.where("commune IS NOT NULL").groupBy("commune").agg(F.max("side").alias("last")).where("last = 0")
    lost = gone.agg(F.count("*").cast("double").alias("n")).where(F.col("n") > COMMUNES_LOST)
    parts.append(lost.select(F.lit("communes lost"), F.lit("all"), F.lit(0.0), "n"))
    if contours is not None:
        missing = orphans(new, contours).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).crossJoin(facts.select(F.col("after").alias("all")))
        parts.append(missing.where((F.col("all") > 0) & (F.col("n") > WITHOUT_CONTOUR * F.col("all"))).select(F.lit("without contour"), F.lit("all"), "all", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def periods_of(addresses: DataFrame, column: str = "url") -> DataFrame:
    """(year, half, first_day, last_day) from file addresses such as .../2021-s2/..."""
    year = F.regexp_extract(column, r"/(\d{4})(?:-s[12])?/", 1).try_cast("int")
    half = F.regexp_extract(column, r"/\d{4}-s([12])/", 1).try_cast("int")
    p = addresses.select(column, year.alias("year"), half.alias("half")).where("year IS NOT NULL")
    first = F.make_date("year", F.when(F.col("half") == 2, 7).otherwise(1), F.lit(1))
    last = F.when(F.col("half") == 1, F.make_date("year", F.lit(6), F.lit(30))).otherwise(F.make_date("year", F.lit(12), F.lit(31)))
    return p.withColumn("first_day", first).withColumn("last_day", last)


def sliding_window(periods: DataFrame, end: str, years: int = 5) -> DataFrame:
    """Periods that touch the `years` before `end`; of one year only the widest."""
    stop = F.lit(end).cast("date")
    start = F.add_months(F.date_add(F.last_day(stop), 1), -12 * years)
    touching = periods.where((F.col("last_day") >= start) & (F.col("first_day") <= stop))
    w = Window.partitionBy("year").orderBy(F.desc(F.datediff("last_day", "first_day")), "first_day")
    return touching.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def source_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, reason) for files that were added, removed or revised: inputs are (name, digest)."""
    both = old.select("name", F.col("digest").alias("a")).join(new.select("name", F.col("digest").alias("b")), "name", "full")
    reason = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "revised")
    return both.select("name", reason.alias("reason")).where("reason IS NOT NULL")


def report(old: DataFrame, new: DataFrame, contours: DataFrame | None = None, department: str = "department") -> DataFrame:
    """(part, subject, name, before, after, change) of a refresh: what its report says, a row for each line.

    Parts: `sales` (the clean ones), `year` (counts), `price` (median per m2 of each department),
    `same period` (the same over the days that both sides cover, which tells revised data from a window
    that moved), `come` and `gone` (communes, with their names), `no contour` (sections and their sales).
    `change` is in percent, NULL where a side is missing or zero. Rows are as few as years, departments,
    communes and sections.
    """

    def sides(part: str, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), "subject", "full")
        return both.select(F.lit(part).alias("part"), "subject", F.lit(None).cast("string").alias("name"), F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))

    of = lambda d, key, value: d.groupBy(F.col(key).cast("string").alias("subject")).agg(value.alias("value")).where("subject IS NOT NULL")
    total = lambda d: d.agg(F.count("*").alias("value")).withColumn("subject", F.lit("all"))
    median, count = F.median("price_m2"), F.count("*")
    rows = sides("sales", total(old), total(new)).unionByName(sides("year", of(old, "year", count), of(new, "year", count)))
    rows = rows.unionByName(sides("price", of(old, department, median), of(new, department, median)))
    a, b = same_period(old, new)
    rows = rows.unionByName(sides("same period", of(a, department, median), of(b, department, median)))
    names = new.unionByName(old, allowMissingColumns=True).groupBy("commune").agg(F.min("commune_name").alias("name"))
    moved = commune_changes(old.where("commune IS NOT NULL"), new.where("commune IS NOT NULL")).join(names, "commune", "left")
    side = lambda change: F.when(F.col("change") == change, 1.0)
    rows = rows.unionByName(moved.select(F.col("change").alias("part"), F.col("commune").alias("subject"), "name", side("gone").alias("before"), side("come").alias("after")))
    if contours is not None:
        lost = orphans(new, contours)
        rows = rows.unionByName(lost.select(F.lit("no contour").alias("part"), F.col("section").alias("subject"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("before"), F.col("n").cast("double").alias("after")))
    return rows.withColumn("change", F.when(F.col("before") > 0, (F.col("after") / F.col("before") - 1) * 100))


_PARTS = (("sales", "Clean sales"), ("year", "Sales by year"), ("price", "Median price per m2 by department"), ("same period", "The same over the days both sides cover"), ("come", "Communes that came"), ("gone", "Communes that went"), ("no contour", "Sections without a contour"))
LISTED = 20  # sections that the text names


def markdown(old: DataFrame, new: DataFrame, contours: DataFrame | None = None, reason: str = "", department: str = "department") -> str:
    """The report of a refresh as text, with its alerts at the end."""
    number = lambda x: "—" if x is None else f"{x:,.0f}".replace(",", " ")
    found: dict[str, list] = {}
    for r in report(old, new, contours, department).orderBy("part", "subject").collect():
        found.setdefault(r["part"], []).append(r)
    lines = ["# Refresh", *(["", f"Reason: {reason}."] if reason else [])]
    for part, title in _PARTS:
        rows = found.get(part, [])
        lines += ["", f"## {title}", ""]
        if part in ("come", "gone"):
            lines.append(", ".join(f"{r['subject']} ({r['name'] or '?'})" for r in rows) or "None.")
        elif part == "no contour":
            more = " …" if len(rows) > LISTED else ""
            lines.append(f"{len(rows)} sections, {number(sum(r['after'] for r in rows))} sales: " + ", ".join(f"{r['subject']} ({r['after']:.0f})" for r in rows[:LISTED]) + more if rows else "None.")
        else:
            lines += ["| | before | after | change |", "|---|---:|---:|---:|"]
            new_or_gone = lambda r: "new" if r["before"] is None else "gone" if r["after"] is None else "" if r["change"] is None else f"{r['change']:+.1f} %"
            lines += [f"| {r['subject']} | {number(r['before'])} | {number(r['after'])} | {new_or_gone(r)} |" for r in rows]
    alerts = guard_rails(old, new, contours, department).orderBy("rule", "subject").collect()
    lines += ["", "## Alerts", ""]
    lines += [f"- {r['rule']}: {r['subject']} ({number(r['before'])} to {number(r['after'])})" for r in alerts] or ["None: the refresh may go ahead."]
    return "\n".join(lines) + "\n"
