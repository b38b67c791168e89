"""Descriptive statistics, outliers, correlation, normality and regression diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import describe, feeds, regression, shapiro
from plumbline.plans.queries.common import rounded, table

NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MIXED = ["l_linenumber", "l_partkey", "l_extendedprice", "l_tax"]
PAIR = ["l_quantity", "l_extendedprice", "l_discount"]


def _lineitem(s, d):
    return table(s, d, "lineitem")


def _each(template: str, cols=tuple(NUM)) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


CELLS = "v AS (" + _each("SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM lineitem") + ")"
FENCES = """q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
count(*) AS n FROM v GROUP BY 1)"""
Z = """z AS (SELECT "column", avg(value) AS mean, stddev_pop(value) AS pop_std, count(*) AS n FROM v GROUP BY 1)"""


def _ranks_sql(cols) -> str:
    return "r AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols) + " FROM lineitem)"


def _outliers_sql(rank: str, kept: str, capped: str) -> str:
    """Values beyond the fences, sorted by their distance from them."""
    return (f'WITH {CELLS}, {FENCES}, o AS (SELECT "column", value, CASE WHEN value < q1 - 0.4 * (q3 - q1) THEN q1 - 0.4 * (q3 - q1) - value '
            "ELSE value - (q3 + 0.4 * (q3 - q1)) END AS distance, count(*) OVER (PARTITION BY \"column\") AS n_outliers "
            "FROM v JOIN q USING (\"column\") WHERE \"column\" IN ('l_quantity', 'l_extendedprice') "
            "AND (value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1))) "
            f'SELECT "column", value, round(distance, 6) AS distance, {rank} AS rank, n_outliers, {capped} AS sample_capped FROM o QUALIFY {kept}')


def _corr_sql(source: str, cols=PAIR) -> str:
    rows = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + (
        "1.0" if a == b else f"round(corr({a}, {b}), 4) + 0.0") + f" AS r, count(*) AS n_used FROM {source}"
            for a in cols for b in cols]
    return " UNION ALL ".join(rows)


MOMENTS = """m AS (SELECT "column", n, avg(pow(value - mean, 2)) AS m2, avg(pow(value - mean, 3)) AS m3,
avg(pow(value - mean, 4)) AS m4 FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS mean,
count(*) OVER (PARTITION BY "column") AS n FROM v) GROUP BY 1, 2)"""
# Least squares of price on quantity, and of the squared residuals on quantity and its square.
FIT = """b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
avg(l_quantity) AS mx FROM lineitem),
e AS (SELECT pow(l_extendedprice - a - b * l_quantity, 2) AS e2, l_quantity - mx AS x, pow(l_quantity - mx, 2) AS x2
FROM lineitem, b),
c AS (SELECT count(*) AS n, corr(e2, x) AS r1, corr(e2, x2) AS r2, corr(x, x2) AS r12 FROM e),
t AS (SELECT 'breusch_pagan' AS test, n, r1 * r1 AS rsq, 1 AS df FROM c UNION ALL
SELECT 'white', n, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12), 2 FROM c)"""



def _horner(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out.replace("e+", "E").replace("e-", "E-")


def _w_sql() -> str:
    """W of every column of v by windows: normal quantiles of all positions, then Royston's weights."""
    (c1, c2), (t1, t2) = shapiro.CENTRE, shapiro.TAIL
    poly = {k: _horner(list(reversed(c)), "u") for k, c in (("c1", shapiro.C1), ("c2", shapiro.C2))}
    return f"""o AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS i,
 count(*) OVER (PARTITION BY "column") AS n, avg(value) OVER (PARTITION BY "column") AS mean FROM v),
 p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o),
 r AS (SELECT *, 0.180625::DOUBLE - (p - 0.5) * (p - 0.5) AS a, sqrt(-ln(least(p, 1 - p))) - 1.6::DOUBLE AS b FROM p),
 m AS (SELECT *, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_horner(c1, 'a')} / {_horner(c2, 'a')}
  ELSE sign(p - 0.5) * {_horner(t1, 'b')} / {_horner(t2, 'b')} END AS m FROM r),
 s AS (SELECT "column", n, sum(m * (value - mean)) AS weighted, sum(m * m) AS norm2, sum((value - mean) * (value - mean)) AS squares,
  max(value) FILTER (i = n) - max(value) FILTER (i = 1) AS outer0, max(value) FILTER (i = n - 1) - max(value) FILTER (i = 2) AS outer1,
  max(m) FILTER (i = n) AS m0, max(m) FILTER (i = n - 1) AS m1, 1 / sqrt(n) AS u FROM m GROUP BY "column", n),
 w AS (SELECT *, m0 / sqrt(norm2) + {poly['c1']} AS a0, m1 / sqrt(norm2) + {poly['c2']} AS a1 FROM s),
 f AS (SELECT *, (norm2 - 2 * m0 * m0 - 2 * m1 * m1) / (1 - 2 * a0 * a0 - 2 * a1 * a1) AS phi FROM w)
 SELECT "column", n AS n_used, round(pow((weighted - m0 * outer0 - m1 * outer1) / sqrt(phi) + a0 * outer0 + a1 * outer1, 2) / squares, 6)
  AS statistic, n > 5000 AS large_sample FROM f"""


QUERIES = {
    "numeric_range_lineitem": (
        lambda s, d: describe.numeric_range(_lineitem(s, d), NUM),
        f'WITH {CELLS} SELECT "column", min(value) AS "min", max(value) AS "max" FROM v GROUP BY 1'),
    "min_max_orders": (
        lambda s, d: describe.min_max(table(s, d, "orders").withColumn("is_open", F.col("o_orderstatus") == "O")),
        "SELECT 'o_orderkey' AS \"column\", min(o_orderkey)::VARCHAR AS \"min\", max(o_orderkey)::VARCHAR AS \"max\" "
        "FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders "
        "UNION ALL SELECT 'o_totalprice', min(o_totalprice)::VARCHAR, max(o_totalprice)::VARCHAR FROM orders "
        "UNION ALL SELECT 'o_orderdate', min(o_orderdate)::VARCHAR, max(o_orderdate)::VARCHAR FROM orders "
        "UNION ALL SELECT 'is_open', min(o_orderstatus = 'O')::VARCHAR, max(o_orderstatus = 'O')::VARCHAR FROM orders"),
    "describe_lineitem": (
        lambda s, d: rounded(describe.describe(_lineitem(s, d), NUM), mean=6, std=6, skewness=6, kurtosis=6),
        f'WITH {CELLS} SELECT "column", count(*) AS n, round(avg(value), 6) + 0.0 AS mean, '
        "round(stddev_samp(value), 6) AS std, round(skewness(value), 6) + 0.0 AS skewness, "
        "round(kurtosis(value), 6) + 0.0 AS kurtosis FROM v GROUP BY 1"),
    "medians_lineitem": (
        lambda s, d: rounded(describe.medians(_lineitem(s, d), NUM), median=6),
        f'WITH {CELLS} SELECT "column", round(median(value), 6) AS median FROM v GROUP BY 1'),
    "iqr_outliers_lineitem": (
        lambda s, d: rounded(describe.outliers(_lineitem(s, d), NUM, k=0.4), q1=6, q3=6, lower=6, upper=6),
        f'WITH {CELLS}, {FENCES}, f AS (SELECT *, q1 - 0.4 * (q3 - q1) AS lower, q3 + 0.4 * (q3 - q1) AS upper FROM q) '
        'SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) + 0.0 AS lower, '
        "round(upper, 6) AS upper, n, count(*) FILTER (value < lower OR value > upper) AS n_outliers "
        'FROM v JOIN f USING ("column") GROUP BY ALL'),
    "zscore_outliers_lineitem": (
        lambda s, d: rounded(describe.outliers(_lineitem(s, d), NUM, "zscore", 1.6), mean=6, pop_std=6),
        f'WITH {CELLS}, {Z} SELECT "column", round(mean, 6) AS mean, round(pop_std, 6) AS pop_std, 1.6::DOUBLE AS k, n, '
        "count(*) FILTER (abs((value - mean) / pop_std) > 1.6) AS n_outliers "
        'FROM v JOIN z USING ("column") GROUP BY ALL'),
    "outlier_values_lineitem": (
        lambda s, d: rounded(describe.outlier_values(_lineitem(s, d), ["l_quantity", "l_extendedprice"], k=0.4), distance=6),
        _outliers_sql("rank() OVER (PARTITION BY \"column\" ORDER BY distance DESC)", "true", "false")),
    "outlier_values_furthest_lineitem": (
        lambda s, d: rounded(describe.outlier_values(_lineitem(s, d), ["l_quantity", "l_extendedprice"], k=0.4, limit=500), distance=6),
        _outliers_sql("rank() OVER (PARTITION BY \"column\" ORDER BY distance DESC)",
                      "row_number() OVER (PARTITION BY \"column\" ORDER BY distance DESC, value) <= 500", "n_outliers > 500")),
    "pearson_lineitem": (
        lambda s, d: describe.correlation(_lineitem(s, d), PAIR).drop("error"), _corr_sql("lineitem")),
    "spearman_lineitem": (
        lambda s, d: describe.correlation(_lineitem(s, d), PAIR, "spearman").drop("error"),
        f"WITH {_ranks_sql(PAIR)} {_corr_sql('r')}"),
    "spearman_wide_domain_lineitem": (
        lambda s, d: describe.correlation(_lineitem(s, d), MIXED, "spearman").drop("error"),
        f"WITH {_ranks_sql(MIXED)} {_corr_sql('r', MIXED)}"),
    "jarque_bera_lineitem": (
        lambda s, d: rounded(describe.jarque_bera(_lineitem(s, d), NUM).drop("error"), statistic=4, p_value=8),
        f"WITH {CELLS}, {MOMENTS}, j AS (SELECT *, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + "
        'pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m) SELECT "column", \'jarque_bera\' AS test, n AS n_used, '
        "round(jb, 4) AS statistic, round(exp(-jb / 2), 8) AS p_value, exp(-jb / 2) >= 0.05 AS is_normal FROM j"),
    "shapiro_wilk_lineitem": (
        lambda s, d: rounded(shapiro.shapiro(_lineitem(s, d), NUM).select("column", "n_used", "statistic", "large_sample"), statistic=6),
        f"WITH {CELLS}, {_w_sql()}"),
    "shapiro_wilk_supplier": (
        lambda s, d: rounded(shapiro.shapiro(table(s, d, "supplier"), ["s_acctbal"]).select("column", "n_used", "statistic", "large_sample"), statistic=6),
        f"WITH v AS (SELECT 's_acctbal' AS \"column\", s_acctbal::DOUBLE AS value FROM supplier), {_w_sql()}"),
    "vif_lineitem": (
        lambda s, d: rounded(regression.vif(_lineitem(s, d), PAIR).drop("error"), vif=8),
        "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, "
        "corr(l_extendedprice, l_discount) AS bc FROM lineitem), k AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - "
        "ac * ac - bc * bc AS det FROM c) SELECT 'l_quantity' AS \"column\", round((1 - bc * bc) / det, 8) AS vif FROM k "
        "UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 8) FROM k "
        "UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 8) FROM k"),
    "condition_number_lineitem": (
        lambda s, d: rounded(regression.condition_number(_lineitem(s, d), ["l_discount"]), condition_number=6),
        "WITH g AS (SELECT count(*)::DOUBLE AS n, sum(l_discount) AS s, sum(l_discount * l_discount) AS ss FROM lineitem), "
        "e AS (SELECT (n + ss) / 2 AS h, sqrt(pow((n - ss) / 2, 2) + s * s) AS w FROM g) "
        "SELECT 1 AS n_columns, round(sqrt((h + w) / (h - w)), 6) AS condition_number FROM e"),
    "condition_number_all_lineitem": (
        lambda s, d: regression.condition_number(_lineitem(s, d), NUM), None),
    "ols_lineitem": (
        lambda s, d: rounded(regression.ols(_lineitem(s, d), "l_extendedprice", ["l_quantity"]).select(
            "term", "coef", "std_err", "r_squared", "n_used"), coef=5, std_err=5, r_squared=10),
        "WITH g AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, "
        "regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, "
        "regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem), "
        "v AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM g) "
        "SELECT 'const' AS term, round(a, 5) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 5) AS std_err, "
        "round(r2, 10) AS r_squared, n AS n_used FROM v UNION ALL "
        "SELECT 'l_quantity', round(b, 5), round(sqrt(s2 / sxx), 5), round(r2, 10), n FROM v"),
    "ols_many_lineitem": (
        lambda s, d: regression.ols(_lineitem(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), None),
    "heteroskedasticity_lineitem": (
        lambda s, d: rounded(regression.heteroskedasticity(_lineitem(s, d), "l_extendedprice", ["l_quantity"]).select(
            "test", "lm", "f", "df", "n_used"), lm=6, f=6),
        f"WITH {FIT} SELECT test, round(n * rsq, 6) AS lm, round((rsq / df) / ((1 - rsq) / (n - df - 1)), 6) AS f, "
        "df, n AS n_used FROM t"),
    "white_p_value_lineitem": (
        lambda s, d: rounded(regression.heteroskedasticity(_lineitem(s, d), "l_extendedprice", ["l_quantity"]).where(
            "test = 'white'").select("test", "lm_p"), lm_p=8),
        f"WITH {FIT} SELECT test, round(exp(-n * rsq / 2), 8) AS lm_p FROM t WHERE test = 'white'"),
    "heteroskedasticity_many_lineitem": (
        lambda s, d: regression.heteroskedasticity(
            _lineitem(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), None),
    "group_means_customer": (
        lambda s, d: rounded(feeds.group_means(table(s, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]),
                             mean=6, sd=6),
        " UNION ALL ".join(
            f"SELECT c_mktsegment AS level, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS sd FROM customer GROUP BY 1" for c in ("c_acctbal", "c_nationkey"))),
    "box_summary_part": (
        lambda s, d: rounded(feeds.box_summary(table(s, d, "part"), ["p_retailprice"], "p_type"),
                             q1=6, median=6, q3=6, whisker_low=6, whisker_high=6),
        "WITH q AS (SELECT p_type AS level, quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS median, "
        "quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1) SELECT 'p_retailprice' AS \"column\", level, "
        "round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
        "round(min(p_retailprice) FILTER (p_retailprice >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, "
        "round(max(p_retailprice) FILTER (p_retailprice <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, count(*) AS n, "
        "count(*) FILTER (p_retailprice < q1 - 1.5 * (q3 - q1) OR p_retailprice > q3 + 1.5 * (q3 - q1)) AS n_outliers "
        "FROM part JOIN q ON p_type = level GROUP BY level, q.q1, q.median, q.q3"),
    "scatter_pairs_lineitem": (lambda s, d: feeds.scatter_pairs(_lineitem(s, d), NUM), None),
}
