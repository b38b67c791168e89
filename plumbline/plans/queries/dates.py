"""Date coverage of tables and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.columns import to_moment
from plumbline.functions.tables import write_table
from plumbline.operators import dates, roles
from plumbline.plans.queries.common import as_text, monthly_panel, rounded, table

TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _runs(s, d, entity=True):
    return dates.date_runs(table(s, d, "orders"), "o_orderdate", ["o_orderpriority"] if entity else None)


STEPS = """p AS (SELECT o_orderpriority, o_orderdate AS ts, lag(o_orderdate) OVER
(PARTITION BY o_orderpriority ORDER BY o_orderdate) AS prev FROM orders),
d AS (SELECT *, date_diff('day', prev, ts) AS delta FROM p WHERE prev IS NOT NULL),
md AS (SELECT o_orderpriority, median(delta) AS median_days FROM d GROUP BY 1)"""
HIST = "h AS (SELECT o_orderpriority, delta, count(*) AS n FROM d GROUP BY ALL)"
DISTINCT = """u AS (SELECT DISTINCT o_orderpriority, o_orderdate AS ts FROM orders),
e AS (SELECT o_orderpriority, min(ts) AS lo, max(ts) AS hi, count(*) AS actual FROM u GROUP BY 1)"""
DAY_GRID = """g AS (SELECT o_orderpriority, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM e),
x AS (SELECT * FROM g ANTI JOIN u USING (o_orderpriority, ts))"""
# Month starts inside the range of every entity.
MONTH_GRID = """g AS (SELECT * FROM (SELECT o_orderpriority, lo, hi, unnest(generate_series(date_trunc('month', lo), hi,
INTERVAL 1 MONTH)) AS ts FROM e) WHERE ts >= lo),
x AS (SELECT * FROM g ANTI JOIN u USING (o_orderpriority, ts))"""
# Daily mean per entity and the day grid between its first and last day.
FILL = f"""{DISTINCT}, g AS (SELECT o_orderpriority, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM e),
m AS (SELECT o_orderpriority, o_orderdate AS ts, avg(o_totalprice) AS y FROM orders GROUP BY ALL),
j AS (SELECT g.o_orderpriority, g.ts, m.y, CASE WHEN m.y IS NOT NULL THEN g.ts END AS seen
 FROM g LEFT JOIN m USING (o_orderpriority, ts)),
k AS (SELECT *, max(seen) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS t0,
 min(seen) OVER (PARTITION BY o_orderpriority ORDER BY ts DESC) AS t1 FROM j),
w AS (SELECT k.*, a.y AS y0, b.y AS y1 FROM k JOIN m a ON a.o_orderpriority = k.o_orderpriority AND a.ts = t0
 JOIN m b ON b.o_orderpriority = k.o_orderpriority AND b.ts = t1)"""


def _filled(action: str):
    return lambda s, d: as_text(rounded(dates.fill_gaps(
        table(s, d, "orders"), "o_orderdate", "o_totalprice", "D", action, ["o_orderpriority"]), y=7), "ts")


def _fill_sql(value: str, where: str = "true") -> str:
    return (f"WITH {FILL} SELECT o_orderpriority, {TEXT.format('ts')} AS ts, round({value}, 7) AS y, "
            f"y IS NULL AS is_filled FROM w WHERE {where}")


def mixed_panel(spark, folder):
    """Entities on days, on Sundays and on month ends, each with holes."""
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_orderdate")
    sunday = F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 6)
    month_end = F.last_day("o_orderdate")
    pick = [("daily", "1-URGENT", F.col("o_orderdate").cast("date"), F.lit(True)),
            ("weekly", "2-HIGH", sunday, F.floor(F.datediff(sunday, F.lit("1992-01-05").cast("date")) / 7) % 9 != 0),
            ("monthly", "3-MEDIUM", month_end, F.month(month_end) % 5 != 0)]
    out = None
    for name, priority, day, kept in pick:
        one = orders.where((F.col("o_orderpriority") == priority) & kept).select(F.lit(name).alias("entity"), day.cast("timestamp_ntz").alias("ts")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def mixed_runs(spark, folder):
    """(dates of the mixed panel, frequency of every entity as inferred)."""
    runs = dates.date_runs(mixed_panel(spark, folder), "ts", ["entity"])
    return runs, write_table(dates.infer_frequency(runs).select("entity", "freq"))


MIXED = """u AS (SELECT DISTINCT 'daily' AS entity, o_orderdate::TIMESTAMP AS ts FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT DISTINCT 'weekly', date_trunc('week', o_orderdate)::DATE + INTERVAL 6 DAY FROM orders WHERE o_orderpriority = '2-HIGH'
 AND (date_diff('day', DATE '1992-01-05', (date_trunc('week', o_orderdate)::DATE + INTERVAL 6 DAY)::DATE) // 7) % 9 <> 0 UNION ALL
SELECT DISTINCT 'monthly', last_day(o_orderdate)::TIMESTAMP FROM orders WHERE o_orderpriority = '3-MEDIUM' AND month(o_orderdate) % 5 <> 0),
e AS (SELECT entity, min(ts) AS lo, max(ts) AS hi, count(*) AS actual FROM u GROUP BY 1),
g AS (SELECT entity, unnest(generate_series(lo, hi, CASE entity WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END)) AS ts
 FROM e WHERE entity <> 'monthly' UNION ALL
 SELECT entity, last_day(m)::TIMESTAMP FROM (SELECT entity, unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m
 FROM e WHERE entity = 'monthly')),
x AS (SELECT * FROM g ANTI JOIN u USING (entity, ts))"""

# Ways to write the date of an order as text.
WRITTEN = {"iso_t": "yyyy-MM-dd'T'HH:mm:ss", "fraction": "yyyy-MM-dd HH:mm:ss.SSS", "zoned": "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "us": "M/d/yyyy",
           "european": "d.M.yyyy", "named": "d MMM yyyy", "full": "MMMM d, yyyy", "day_name": "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "compact": "yyyyMMdd"}


def written_dates(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate", *[
        F.date_format("o_orderdate", f).alias(name) for name, f in WRITTEN.items()])


def read_dates(spark, folder):
    """Every way read back, with the order of day and month that its column settles."""
    rows = written_dates(spark, folder)
    swapped = {r["column"]: r["day_first"] for r in roles.detect_dates(rows.select(*WRITTEN)).collect()}
    return as_text(rows.select("o_orderkey", *[to_moment(rows, c, day_first=swapped[c]).alias(c) for c in WRITTEN]), *WRITTEN)


QUERIES = {
    "date_shapes_orders": (
        lambda s, d: roles.detect_dates(written_dates(s, d).select(*WRITTEN)).select("column", "parse_ratio", "best_format", "day_first", "is_date"),
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 1.0::DOUBLE AS parse_ratio, '{shape}' AS best_format, {c == 'european'} AS day_first, true AS is_date"
                           for c, shape in zip(WRITTEN, ("y-m-d", "y-m-d", "y-m-d", "m-d-y", "d-m-y", "d name y", "name d y", "d name y", "yyyymmdd")))),
    "dates_in_text_orders": (
        read_dates, "SELECT o_orderkey, " + ", ".join(f"{TEXT.format('o_orderdate')} AS {c}" for c in WRITTEN) + " FROM orders"),
    "missing_dates_mixed_panel": (
        lambda s, d: as_text(dates.missing_dates(*mixed_runs(s, d)), "missing_ts"),
        f"WITH {MIXED} SELECT entity, {TEXT.format('ts')} AS missing_ts FROM x"),
    "missing_date_counts_mixed_panel": (
        lambda s, d: as_text(dates.missing_date_counts(*mixed_runs(s, d)), "start", "end"),
        f"WITH {MIXED}, k AS (SELECT entity, count(*) AS m FROM x GROUP BY 1), n AS (SELECT entity, count(*) AS n FROM g GROUP BY 1) "
        f"SELECT entity, {TEXT.format('lo')} AS \"start\", {TEXT.format('hi')} AS \"end\", CASE entity WHEN 'daily' THEN 'D' WHEN 'weekly' THEN 'W' "
        "ELSE 'M' END AS frequency, coalesce(m, 0) AS missing_count, n AS expected_length, actual AS actual_length "
        "FROM e JOIN n USING (entity) LEFT JOIN k USING (entity)"),
    "date_range_orders": (
        lambda s, d: as_text(dates.date_range(table(s, d, "orders"), "o_orderdate", ["o_orderpriority"]).drop("error"),
                             "start", "end"),
        f"SELECT o_orderpriority, {TEXT.format('min(o_orderdate)')} AS \"start\", {TEXT.format('max(o_orderdate)')} "
        "AS \"end\", count(*) AS n FROM orders GROUP BY 1"),
    "delta_counts_orders": (
        lambda s, d: dates.delta_counts(_runs(s, d)),
        f"WITH {STEPS}, {HIST} SELECT o_orderpriority, delta AS delta_days, n FROM h"),
    "delta_counts_events": (
        lambda s, d: dates.delta_counts(dates.date_runs(table(s, d, "events"), "ts", ["user_id"])),
        "WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) "
        "SELECT user_id, round_even(date_diff('microsecond', prev, ts) / 86400000000.0, 0)::BIGINT AS delta_days, "
        "count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL"),
    "frequency_orders": (
        lambda s, d: dates.frequency(_runs(s, d), "D").drop("error"),
        f"WITH {STEPS}, {HIST}, c AS (SELECT o_orderpriority, first(delta ORDER BY n DESC, delta) AS most_common, "
        "count(*) AS n_deltas, sum(n)::BIGINT + 1 AS n_observations FROM h GROUP BY 1) "
        "SELECT o_orderpriority, n_observations, n_deltas, most_common, median_days, n_deltas = 1 AS is_regular, "
        "most_common = 1 AS expected_match FROM c JOIN md USING (o_orderpriority)"),
    "gaps_orders": (
        lambda s, d: as_text(dates.gaps(_runs(s, d)), "start", "end"),
        f"WITH {STEPS} SELECT o_orderpriority, {TEXT.format('prev')} AS \"start\", {TEXT.format('ts')} AS \"end\", "
        "delta AS delta_days FROM d JOIN md USING (o_orderpriority) WHERE delta > 2 * median_days"),
    "missing_dates_orders": (
        lambda s, d: as_text(dates.missing_dates(_runs(s, d), "D"), "missing_ts"),
        f"WITH {DISTINCT}, {DAY_GRID} SELECT o_orderpriority, {TEXT.format('ts')} AS missing_ts FROM x"),
    "missing_date_counts_orders": (
        lambda s, d: as_text(dates.missing_date_counts(_runs(s, d), "D"), "start", "end"),
        f"WITH {DISTINCT}, {DAY_GRID}, k AS (SELECT o_orderpriority, count(*) AS m FROM x GROUP BY 1) "
        f"SELECT o_orderpriority, {TEXT.format('lo')} AS \"start\", {TEXT.format('hi')} AS \"end\", 'D' AS frequency, "
        "coalesce(m, 0) AS missing_count, date_diff('day', lo, hi) + 1 AS expected_length, actual AS actual_length "
        "FROM e LEFT JOIN k USING (o_orderpriority)"),
    "missing_month_starts_orders": (
        lambda s, d: as_text(dates.missing_dates(_runs(s, d), "MS"), "missing_ts"),
        f"WITH {DISTINCT}, {MONTH_GRID} SELECT o_orderpriority, {TEXT.format('ts')} AS missing_ts FROM x"),
    "frequency_inference_monthly": (
        lambda s, d: as_text(dates.infer_frequency(dates.date_runs(monthly_panel(s, d), "month", ["o_orderpriority"]))
                             .drop("error"), "start", "end"),
        "WITH u AS (SELECT DISTINCT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS ts FROM orders), "
        "p AS (SELECT *, lag(ts) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS prev FROM u), "
        "c AS (SELECT o_orderpriority, min(ts) AS lo, max(ts) AS hi, count(*) AS n, "
        "min(date_diff('month', prev, ts)) AS a, max(date_diff('month', prev, ts)) AS b FROM p GROUP BY 1), "
        "h AS (SELECT o_orderpriority, date_diff('day', prev, ts) AS delta, count(*) AS n FROM p WHERE prev IS NOT NULL "
        "GROUP BY ALL), k AS (SELECT o_orderpriority, first(delta ORDER BY n DESC, delta) AS d FROM h GROUP BY 1), "
        "f AS (SELECT *, CASE WHEN n >= 3 AND a = b AND a = 1 THEN 'MS' END AS x, "
        "CASE WHEN d = 1 THEN 'D' WHEN d = 7 THEN 'W' WHEN d BETWEEN 28 AND 31 THEN 'M' WHEN d BETWEEN 89 AND 92 THEN 'Q' "
        "WHEN d BETWEEN 360 AND 370 THEN 'A' END AS y FROM c JOIN k USING (o_orderpriority)) "
        f"SELECT o_orderpriority, {TEXT.format('lo')} AS \"start\", {TEXT.format('hi')} AS \"end\", n, x AS freq_exact, "
        "y AS freq_fallback, coalesce(x, y) AS freq, CASE left(coalesce(x, y), 1) WHEN 'D' THEN 7 WHEN 'W' THEN 52 "
        "WHEN 'M' THEN 12 WHEN 'Q' THEN 4 WHEN 'A' THEN 1 END AS seasonal_period FROM f"),
    "frequency_fallback_daily": (
        lambda s, d: dates.infer_frequency(dates.date_runs(
            table(s, d, "orders").select("o_orderpriority", "o_orderdate").distinct(), "o_orderdate",
            ["o_orderpriority"])).select("o_orderpriority", "n", "freq_fallback"),
        "WITH u AS (SELECT DISTINCT o_orderpriority, o_orderdate AS ts FROM orders), "
        "p AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY o_orderpriority ORDER BY ts), ts) AS d FROM u), "
        "h AS (SELECT o_orderpriority, d, count(*) AS c FROM p WHERE d IS NOT NULL GROUP BY ALL), "
        "k AS (SELECT o_orderpriority, first(d ORDER BY c DESC, d) AS d, sum(c)::BIGINT + 1 AS n FROM h GROUP BY 1) "
        "SELECT o_orderpriority, n, CASE WHEN d = 1 THEN 'D' WHEN d = 7 THEN 'W' WHEN d BETWEEN 28 AND 31 THEN 'M' "
        "WHEN d BETWEEN 89 AND 92 THEN 'Q' WHEN d BETWEEN 360 AND 370 THEN 'A' END AS freq_fallback FROM k"),
    "frequency_inference_events": (
        lambda s, d: dates.infer_frequency(dates.date_runs(
            table(s, d, "events").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
            .distinct(), "day", ["event_type"])).select("event_type", "n", "freq_exact", "freq", "seasonal_period"),
        "WITH u AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS ts FROM events), "
        "p AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts) AS d FROM u) "
        "SELECT event_type, count(*) AS n, CASE WHEN min(d) = 1 AND max(d) = 1 THEN 'D' END AS freq_exact, "
        "CASE WHEN mode(d) = 1 THEN 'D' END AS freq, CASE WHEN mode(d) = 1 THEN 7 END AS seasonal_period "
        "FROM p GROUP BY 1"),
    "gap_fill_ignore_orders": (_filled("ignore"), _fill_sql("y")),
    "gap_fill_forward_orders": (_filled("forward_fill"), _fill_sql("y0")),
    "gap_fill_interpolate_orders": (
        _filled("interpolate"),
        _fill_sql("coalesce(y, y0 + (y1 - y0) * date_diff('day', t0, ts) / date_diff('day', t0, t1))")),
    "gap_fill_drop_orders": (_filled("drop"), _fill_sql("y", "y IS NOT NULL")),
}
