"""Panels: orders by priority, customers over time, events by type."""

from __future__ import annotations

from plumbline.operators import feeds, panel
from plumbline.plans.queries.common import as_text, monthly_panel, rounded, table
from plumbline.plans.queries.dates import HIST, STEPS, TEXT

VAR = """v AS (SELECT o_orderpriority AS e, 'o_totalprice' AS c, o_totalprice AS x FROM orders UNION ALL
SELECT o_orderpriority, 'o_custkey', o_custkey::DOUBLE FROM orders),
p AS (SELECT c, e, avg(x) AS m, var_samp(x) AS w FROM v GROUP BY ALL),
q AS (SELECT c, var_samp(x) AS o FROM v GROUP BY 1),
r AS (SELECT c, o, var_samp(m) AS b, avg(w) AS w FROM p JOIN q USING (c) GROUP BY ALL)"""
MODES = """c AS (SELECT o_orderpriority, first(delta ORDER BY n DESC, delta) AS most_common, count(*) = 1 AS is_regular,
sum(n)::BIGINT + 1 AS n_observations FROM h GROUP BY 1),
dom AS (SELECT most_common AS dominant FROM c GROUP BY 1 ORDER BY count(*) DESC, most_common LIMIT 1)"""


def _orders(s, d):
    return table(s, d, "orders")


QUERIES = {
    "panel_ranges_orders": (
        lambda s, d: as_text(panel.panel_ranges(_orders(s, d), "o_orderpriority", "o_orderdate"), "start", "end"),
        f"SELECT o_orderpriority AS entity, CASE WHEN grouping(o_orderpriority) = 1 THEN 'panel' ELSE 'entity' END AS level, "
        f"{TEXT.format('min(o_orderdate)')} AS \"start\", {TEXT.format('max(o_orderdate)')} AS \"end\", count(*) AS n "
        "FROM orders GROUP BY ROLLUP (o_orderpriority)"),
    "panel_balance_orders": (
        lambda s, d: panel.balance(_orders(s, d), "o_orderpriority", "o_orderdate"),
        "WITH b AS (SELECT count(DISTINCT o_orderpriority) AS e, count(DISTINCT o_orderdate) AS p, "
        "count(DISTINCT (o_orderpriority, o_orderdate)) AS a FROM orders) SELECT e AS n_entities, p AS n_time_periods, "
        "e * p AS expected_obs, a AS actual_obs, a = e * p AS is_balanced, e * p - a AS missing_combinations, "
        "round(a::DOUBLE / (e * p), 4) AS balance_ratio FROM b"),
    "panel_balance_monthly": (
        lambda s, d: panel.balance(monthly_panel(s, d), "o_orderpriority", "month"),
        "WITH b AS (SELECT count(DISTINCT o_orderpriority) AS e, count(DISTINCT date_trunc('month', o_orderdate)) AS p, "
        "count(DISTINCT (o_orderpriority, date_trunc('month', o_orderdate))) AS a FROM orders) SELECT e AS n_entities, "
        "p AS n_time_periods, e * p AS expected_obs, a AS actual_obs, a = e * p AS is_balanced, "
        "e * p - a AS missing_combinations, round(a::DOUBLE / (e * p), 4) AS balance_ratio FROM b"),
    "panel_variance_orders": (
        lambda s, d: rounded(panel.variance_decomposition(_orders(s, d), "o_orderpriority", ["o_totalprice", "o_custkey"]),
                             overall_variance=1, between_variance=1, within_variance=1),
        f"WITH {VAR} SELECT c AS \"column\", round(o, 1) AS overall_variance, round(b, 1) AS between_variance, "
        "round(w, 1) AS within_variance, round(b / o * 100, 2) AS between_pct, round(w / o * 100, 2) AS within_pct FROM r"),
    "panel_frequency_orders": (
        lambda s, d: panel.panel_frequency(_orders(s, d), "o_orderpriority", "o_orderdate"),
        f"WITH {STEPS}, {HIST}, {MODES} SELECT o_orderpriority, n_observations, most_common, median_days, is_regular, "
        "dominant, most_common = dominant AS matches FROM c JOIN md USING (o_orderpriority), dom"),
    "panel_consistency_customers": (
        lambda s, d: panel.panel_consistency(panel.panel_frequency(_orders(s, d), "o_custkey", "o_orderdate")),
        "WITH p AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), "
        "o_orderdate) AS d FROM orders), h AS (SELECT o_custkey, d, count(*) AS n FROM p WHERE d IS NOT NULL GROUP BY ALL), "
        "c AS (SELECT o_custkey, first(d ORDER BY n DESC, d) AS m FROM h GROUP BY 1), "
        "dom AS (SELECT m AS dominant FROM c GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1), "
        "a AS (SELECT DISTINCT o_custkey FROM orders) SELECT max(dominant) AS dominant, "
        "count(*) FILTER (m IS NOT DISTINCT FROM dominant) AS n_matching, "
        "count(*) FILTER (m IS DISTINCT FROM dominant) AS n_mismatching, "
        "bool_and(m IS NOT DISTINCT FROM dominant) AS consistent FROM a LEFT JOIN c USING (o_custkey), dom"),
    "panel_average_orders": (
        lambda s, d: as_text(rounded(panel.panel_average(_orders(s, d), "o_orderdate", "o_totalprice"), mean=7), "ts"),
        f"SELECT {TEXT.format('o_orderdate')} AS ts, round(avg(o_totalprice), 7) AS mean FROM orders GROUP BY o_orderdate"),
    "snapshot_lineitem": (
        lambda s, d: as_text(panel.snapshot(table(s, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice"), "ts"),
        f"SELECT l_suppkey AS entity, {TEXT.format('l_shipdate')} AS ts, l_extendedprice AS value FROM lineitem "
        "WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem) ORDER BY value DESC, entity LIMIT 30"),
    "top_entities_orders": (
        lambda s, d: panel.top_entities(_orders(s, d), "o_custkey"),
        "SELECT o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, entity LIMIT 20"),
    "rows_of_top_entities_orders": (
        lambda s, d: panel.rows_of_top_entities(_orders(s, d), "o_custkey").select("o_orderkey", "o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, count(*) AS n "
        "FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20))"),
    "line_lineitem": (
        lambda s, d: as_text(rounded(feeds.line(table(s, d, "lineitem"), "l_shipdate", "l_quantity"), mean=9), "ts"),
        f"SELECT {TEXT.format('l_shipdate')} AS ts, round(avg(l_quantity), 9) AS mean FROM lineitem GROUP BY l_shipdate"),
    "faceted_series_orders": (
        lambda s, d: as_text(feeds.faceted(_orders(s, d), "o_custkey", "o_orderdate", "o_totalprice"), "ts"),
        f"SELECT o_custkey::VARCHAR AS entity, {TEXT.format('o_orderdate')} AS ts, o_totalprice AS y FROM orders "
        "WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 "
        "ORDER BY n DESC, o_custkey LIMIT 16))"),
}
