"""Missing values, duplicates and column roles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import to_moment, to_number
from plumbline.operators import describe, duplicates, missing, roles
from plumbline.plans.queries.common import as_text, rounded, table


# The tables have no missing values, so some values are blanked out, in SQL the same way.
def holes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "nullif(l_linenumber, 7) AS l_linenumber", "nullif(l_returnflag, 'A') AS l_returnflag",
        "nullif(l_linestatus, 'F') AS l_linestatus", "nullif(l_discount, 0.0D) AS l_discount",
        "nullif(l_quantity, 13.0D) AS l_quantity", "l_tax")


HOLES = """h AS (SELECT nullif(l_linenumber, 7) AS l_linenumber, nullif(l_returnflag, 'A') AS l_returnflag,
nullif(l_linestatus, 'F') AS l_linestatus, nullif(l_discount, 0.0) AS l_discount,
nullif(l_quantity, 13.0) AS l_quantity, l_tax FROM lineitem)"""
HOLE_COLS = {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_discount": "double",
             "l_quantity": "double", "l_tax": "double"}
PER_COLUMN = "c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS n_missing, count(*) AS n FROM h"
    for c, k in HOLE_COLS.items()) + ")"
PER_ROW = "m AS (SELECT " + " + ".join(f"({c} IS NULL)::INT" for c in HOLE_COLS) + " AS m FROM h)"


def orders_slim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")


def order_flags(spark: SparkSession, folder: str, **options) -> DataFrame:
    return duplicates.flag_duplicates(orders_slim(spark, folder), "o_orderkey", "o_orderpriority",
                                      "o_orderdate", **options)


ORDER_GROUPS = """g AS (SELECT o_orderdate, o_orderpriority, o_orderstatus, count(*) AS copies,
min(o_orderkey) AS group_id FROM orders GROUP BY ALL),
f AS (SELECT o.o_orderkey, g.copies > 1 AS dup, CASE WHEN g.copies > 1 THEN g.group_id END AS group_id
FROM orders o JOIN g USING (o_orderdate, o_orderpriority, o_orderstatus))"""

NEAR = """near AS (SELECT a.o_orderkey,
 EXISTS (SELECT 1 FROM orders b WHERE b.o_orderdate = a.o_orderdate AND b.o_orderkey <> a.o_orderkey
  AND (b.o_orderpriority = a.o_orderpriority)::INT + (b.o_orderstatus = a.o_orderstatus)::INT >= 1) AS rule_b
 FROM orders a)"""


# Wide tables: the orders of a customer share most columns, each but a few; in the second table half of the rows have one date.
def wide_orders(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "date_add(date '1992-01-01', cast(o_custkey % 240 AS int)) AS day", "o_orderstatus AS status",
        *[f"{_wide_column(i, n)} AS c{i}" for i in range(n)])


def _wide_column(i: int, n: int) -> str:
    """Column ``i`` of ``n``: the customer's value, and in up to two of all columns the order's own."""
    return (f"CASE WHEN (o_orderkey * 11 + {7 * i}) % {n} < o_orderkey % 3 THEN o_orderkey % 10 + {1000 * i} "
            f"ELSE o_custkey * {i + 3} % {11 + i} END")


def wide_customers(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey", f"CASE WHEN c_custkey % 2 = 0 THEN date '2000-01-01' ELSE {_customer_day('date_add')} END AS day",
        *[f"{_customer_column(i)} AS c{i}" for i in range(n)])


def _customer_day(add: str) -> str:
    return f"{add}(date '2000-01-02', cast(c_custkey % 50 AS int))"


def _customer_column(i: int) -> str:
    """Families of eight rows; each row has values of its own here and there."""
    return f"CASE WHEN (c_custkey * 13 + {7 * i}) % 37 = 0 THEN c_custkey ELSE floor(c_custkey / 16) * {i + 1} % {3 + i % 5} END"


def _near_sql(rows: str, row_id: str, keys: list[str], cols: list[str], least: int) -> str:
    """Does another row have the same keys and at least ``least`` equal columns? By pairs of rows."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    equal = " + ".join(f"(a.{c} = b.{c})::INT" for c in cols)
    return (f"SELECT DISTINCT a.{row_id} FROM {rows} a JOIN {rows} b ON {same} AND a.{row_id} <> b.{row_id} AND {equal} >= {least}")


def wide_orders_query(n: int) -> tuple:
    cols = [f"c{i}" for i in range(n)]
    select = ", ".join(f"{_wide_column(i, n)} AS c{i}" for i in range(n))
    sql = ("WITH w AS MATERIALIZED (SELECT o_orderkey, date '1992-01-01' + (o_custkey % 240)::INT AS day, "
           f"o_orderstatus AS status, {select} FROM orders), "
           f"g AS (SELECT day, status, {', '.join(cols)}, count(*) AS copies FROM w GROUP BY ALL), "
           f"b AS ({_near_sql('w', 'o_orderkey', ['day'], ['status', *cols], math.ceil((n + 1) * 0.95))}), "
           f"c AS ({_near_sql('w', 'o_orderkey', ['status', 'day'], cols, math.ceil(n * 0.95))}) "
           "SELECT o_orderkey, copies > 1 AS rule_a, o_orderkey IN (SELECT o_orderkey FROM b) AS rule_b, o_orderkey IN (SELECT o_orderkey FROM c) AS rule_c "
           f"FROM w JOIN g USING (day, status, {', '.join(cols)})")
    return (lambda s, d: duplicates.flag_duplicates(wide_orders(s, d, n), "o_orderkey", "status", "day").select(
        "o_orderkey", "rule_a", "rule_b", "rule_c"), sql)


def wide_customers_query(n: int) -> tuple:
    cols = [f"c{i}" for i in range(n)]
    select = ", ".join(f"{_customer_column(i)} AS c{i}" for i in range(n))
    sql = (f"WITH w AS MATERIALIZED (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN date '2000-01-01' ELSE "
           f"date '2000-01-02' + (c_custkey % 50)::INT END AS day, {select} FROM customer), "
           f"b AS ({_near_sql('w', 'c_custkey', ['day'], cols, math.ceil(n * 0.95))}) "
           "SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM b) AS rule_b FROM w")
    return (lambda s, d: duplicates.flag_duplicates(wide_customers(s, d, n), "c_custkey", date="day").select("c_custkey", "rule_b"), sql)


def dataset_types(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("events", ["ts"]), ("orders", ["o_orderdate"]), ("part", []), ("lineitem", ["l_shipdate"])]
    out = None
    for name, dates in parts:
        one = roles.classify(table(spark, folder, name), dates).select(
            F.lit(name).alias("table_name"), "dataset_type", "reason", "n_rows", "n_dates")
        out = one if out is None else out.unionByName(one)
    return out


def date_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderdate", "cast(o_orderdate AS string) AS order_day_text",
        "concat(o_orderstatus, '%') AS change_text",
        "CASE WHEN o_orderpriority < '3' THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderstatus END AS ship_date",
        "CASE WHEN o_orderpriority < '3' THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderstatus END AS shipped")
    return rounded(roles.detect_dates(df).select(
        "column", "position", "name_score", "parse_ratio", "is_date"), parse_ratio=6)


def coerced(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "substr(o_orderpriority, 1, 1) AS digit", "o_orderstatus",
        "CASE WHEN o_orderstatus = 'F' THEN 'no date' ELSE cast(o_orderdate AS string) END AS day")
    return as_text(df.select("o_orderkey", to_number(df, "digit").alias("digit"),
                             to_number(df, "o_orderstatus").alias("status"),
                             to_moment(df, "day").alias("day")), "day")


QUERIES = {
    "missing_columns_lineitem": (
        lambda s, d: missing.missing_columns(holes(s, d)),
        f"WITH {HOLES}, {PER_COLUMN} SELECT \"column\", dtype, n_missing, round(n_missing * 100.0 / n, 2) AS pct "
        "FROM c WHERE n_missing > 0"),
    "missing_total_lineitem": (
        lambda s, d: missing.missing_total(holes(s, d)),
        f"WITH {HOLES}, {PER_ROW} SELECT count(*) AS n_rows, 6 AS n_columns, count(*) * 6 AS total_cells, "
        "sum(m)::BIGINT AS total_missing, round(sum(m) * 100.0 / (count(*) * 6), 4) AS missing_percentage, "
        "count(*) FILTER (m = 0) AS complete_rows, round(count(*) FILTER (m = 0) * 100.0 / count(*), 2) "
        "AS complete_row_percentage FROM m"),
    "missing_bands_lineitem": (
        lambda s, d: missing.missing_bands(holes(s, d)),
        f"WITH {HOLES}, {PER_ROW} " + " UNION ALL ".join(
            f"SELECT '{band}' AS band, count(*) FILTER ({cond}) AS n_rows FROM m" for band, cond in (
                ("complete (0%)", "m = 0"), ("low (0-10%)", "m > 0 AND m * 100.0 / 6 <= 10"),
                ("moderate (10-50%)", "m * 100.0 / 6 > 10 AND m * 100.0 / 6 <= 50"),
                ("high (50-90%)", "m * 100.0 / 6 > 50 AND m * 100.0 / 6 <= 90"),
                ("mostly empty (>90%)", "m * 100.0 / 6 > 90")))),
    "missing_by_type_lineitem": (
        lambda s, d: missing.missing_by_type(holes(s, d)),
        f"WITH {HOLES}, {PER_COLUMN} SELECT dtype, count(*) AS n_columns, sum(n_missing)::BIGINT AS n_missing "
        "FROM c GROUP BY 1"),
    "populated_columns_lineitem": (
        lambda s, d: missing.populated_columns(holes(s, d)),
        f"WITH {HOLES}, {PER_COLUMN} SELECT \"column\" FROM c WHERE n_missing = 0"),
    "duplicate_flags_orders": (
        lambda s, d: order_flags(s, d),
        f"WITH {ORDER_GROUPS} SELECT o_orderkey, dup AS rule_a, dup AS rule_b, dup AS rule_c, "
        "dup AS is_duplicate, group_id FROM f"),
    "duplicate_rates_orders": (
        lambda s, d: duplicates.duplicate_rates(order_flags(s, d)),
        f"WITH {ORDER_GROUPS} SELECT count(*) AS n_rows, count(*) FILTER (dup) AS duplicate_count, "
        "count(*) FILTER (dup) AS rule_a, count(*) FILTER (dup) AS rule_b, count(*) FILTER (dup) AS rule_c, "
        "round(count(*) FILTER (dup) * 100.0 / count(*), 4) AS duplicate_percentage FROM f"),
    "duplicate_groups_orders": (
        lambda s, d: duplicates.first_groups(orders_slim(s, d), "o_orderkey", "o_orderpriority", "o_orderdate"),
        f"WITH {ORDER_GROUPS} SELECT group_id, copies, o_orderpriority AS key_o_orderpriority, "
        "o_orderdate::VARCHAR AS key_o_orderdate FROM g WHERE copies > 1 ORDER BY group_id LIMIT 300"),
    "duplicate_group_members_orders": (
        lambda s, d: duplicates.group_members(orders_slim(s, d), "o_orderkey"),
        f"WITH {ORDER_GROUPS} SELECT group_id, o_orderkey FROM f WHERE dup"),
    "duplicate_sample_orders": (
        lambda s, d: as_text(duplicates.duplicate_sample(orders_slim(s, d), order_flags(s, d), "o_orderkey"),
                             "o_orderdate"),
        f"WITH {ORDER_GROUPS} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, "
        "o_orderpriority, o_orderstatus, (SELECT count(*) > 500 FROM f WHERE dup) AS truncated "
        "FROM orders JOIN f USING (o_orderkey) WHERE dup ORDER BY o_orderkey LIMIT 500"),
    "near_duplicates_same_date_orders": (
        lambda s, d: order_flags(s, d, threshold=0.5).select("o_orderkey", "rule_a", "rule_b", "rule_c"),
        f"WITH {ORDER_GROUPS}, {NEAR} SELECT o_orderkey, dup AS rule_a, rule_b, dup AS rule_c "
        "FROM f JOIN near USING (o_orderkey)"),
    "near_duplicates_24_columns_orders": wide_orders_query(24),
    "near_duplicates_60_columns_orders": wide_orders_query(60),
    "near_duplicates_120_columns_orders": wide_orders_query(120),
    "near_duplicates_skewed_date_customer": wide_customers_query(60),
    "key_duplicates_orders": (
        lambda s, d: duplicates.key_duplicates(table(s, d, "orders"), "o_orderkey", ["o_custkey", "o_orderdate"]),
        "SELECT o_orderkey, copies FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) "
        "AS copies FROM orders) WHERE copies > 1"),
    "date_columns_orders": (
        date_columns,
        "WITH r AS (SELECT avg((o_orderpriority < '3')::INT) AS part FROM orders) "
        "SELECT 'o_orderstatus' AS \"column\", 1 AS position, 0 AS name_score, 0.0 AS parse_ratio, false AS is_date "
        "UNION ALL SELECT 'o_orderdate', 2, 1, 1.0, true UNION ALL SELECT 'order_day_text', 3, 1, 1.0, true "
        "UNION ALL SELECT 'change_text', 4, 0, 0.0, false "
        "UNION ALL SELECT 'ship_date', 5, 1, round(part, 6), part > 0.3 FROM r "
        "UNION ALL SELECT 'shipped', 6, 0, round(part, 6), part >= 0.8 FROM r"),
    "coerced_values_orders": (
        coerced,
        "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS digit, "
        "TRY_CAST(o_orderstatus AS DOUBLE) AS status, CASE WHEN o_orderstatus <> 'F' THEN "
        "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day FROM orders"),
    "category_levels_part": (
        lambda s, d: roles.category_levels(table(s, d, "part"), ["p_brand", "p_type", "p_name"]),
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c} AS level, row_number() OVER (ORDER BY {c} COLLATE \"C\") - 1 AS code, "
            f"count(*) AS copies FROM part GROUP BY {c}" for c in ("p_brand", "p_type", "p_name"))
        .replace(' COLLATE "C"', "")),
    "integer_codes_part": (
        lambda s, d: roles.integer_codes(
            table(s, d, "part").withColumn("p_brand", F.expr("nullif(p_brand, 'Brand#3')")),
            ["p_brand", "p_type"], ["p_partkey"]),
        "WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#3') AS p_brand, p_type FROM part), "
        "b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS c FROM p WHERE p_brand IS NOT NULL "
        "GROUP BY 1), t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS c FROM p GROUP BY 1) "
        "SELECT p_partkey, coalesce(b.c, -1) AS p_brand_code, coalesce(t.c, -1) AS p_type_code "
        "FROM p LEFT JOIN b USING (p_brand) LEFT JOIN t USING (p_type)"),
    "one_hot_orders": (
        lambda s, d: roles.one_hot(table(s, d, "orders"), ["o_orderstatus"], ["o_orderkey"]),
        "SELECT o_orderkey, " + ", ".join(
            f"(o_orderstatus = '{v}')::INT::DOUBLE AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders"),
    "dataset_types": (
        dataset_types,
        "SELECT 'events' AS table_name, CASE WHEN count(*) = count(DISTINCT ts) THEN 'time_series' ELSE 'panel' END "
        "AS dataset_type, CASE WHEN count(*) = count(DISTINCT ts) THEN 'Single date column with unique timestamps.' "
        "ELSE 'Date column + entity-like categorical column found.' END AS reason, count(*) AS n_rows, "
        "count(DISTINCT ts) AS n_dates FROM events UNION ALL "
        "SELECT 'orders', 'panel', 'Date column + entity-like categorical column found.', count(*), "
        "count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'part', 'cross_sectional', "
        "'No date columns detected.', count(*), NULL FROM part UNION ALL SELECT 'lineitem', 'panel', "
        "'Date column + entity-like categorical column found.', count(*), count(DISTINCT l_shipdate) FROM lineitem"),
    "complete_cases_lineitem": (
        lambda s, d: describe.complete_cases(holes(s, d), ["l_linenumber", "l_discount", "l_quantity"]),
        f"WITH {HOLES} SELECT l_linenumber::DOUBLE AS l_linenumber, l_discount, l_quantity FROM h "
        "WHERE l_linenumber IS NOT NULL AND l_discount IS NOT NULL AND l_quantity IS NOT NULL"),
    "equal_rows_orders": (
        lambda s, d: roles.equal_rows(table(s, d, "orders"), "o_orderpriority", "1-URGENT").select(
            "o_orderkey", "o_totalprice"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "member_rows_orders": (
        lambda s, d: roles.member_rows(
            table(s, d, "orders"), "o_custkey",
            table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).select(
            "o_orderkey", "o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN "
        "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
}
