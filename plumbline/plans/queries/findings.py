"""Severity findings over the other results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import autocorrelation, breaks, dates, describe, duplicates, missing, panel, regression, seasonal, \
    stationarity
from plumbline.plans import findings as fd
from plumbline.plans.queries.common import DAILY, daily_series, rounded, table
from plumbline.plans.queries.cross_section import CELLS, FENCES, FIT, MOMENTS, NUM, PAIR
from plumbline.plans.queries.dates import HIST, STEPS
from plumbline.plans.queries.quality import HOLES, ORDER_GROUPS, PER_ROW, holes, order_flags
from plumbline.plans.queries.series import ACF, COVS, LAGGED, LB, P12, _event_series


def _lineitem(s, d):
    return table(s, d, "lineitem")


def _runs(s, d):
    return dates.date_runs(table(s, d, "orders"), "o_orderdate", ["o_orderpriority"])


VIF = ("c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, "
       "corr(l_extendedprice, l_discount) AS bc FROM lineitem), k AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - "
       "ac * ac - bc * bc AS det FROM c), v AS (SELECT 'l_quantity' AS subject, (1 - bc * bc) / det AS vif FROM k "
       "UNION ALL SELECT 'l_extendedprice', (1 - ac * ac) / det FROM k UNION ALL SELECT 'l_discount', (1 - ab * ab) / det FROM k)")

QUERIES = {
    "findings_outliers_lineitem": (
        lambda s, d: fd.outlier_findings(describe.outliers(_lineitem(s, d), NUM, k=0.4)),
        f'WITH {CELLS}, {FENCES} SELECT \'outliers\' AS operator, "column" AS subject, \'n_outliers\' AS metric, '
        "n_out::DOUBLE AS value, CASE WHEN n_out > 0 THEN 'bad' ELSE 'ok' END AS severity, "
        "CASE WHEN n_out > 0 THEN 'Outliers found' ELSE 'No outliers' END AS message FROM (SELECT \"column\", "
        "count(*) FILTER (value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1)) AS n_out "
        'FROM v JOIN q USING ("column") GROUP BY 1)'),
    "findings_vif_lineitem": (
        lambda s, d: rounded(fd.vif_findings(regression.vif(_lineitem(s, d), PAIR)), value=8),
        f"WITH {VIF} SELECT 'vif' AS operator, subject, 'vif' AS metric, round(vif, 8) AS value, "
        "CASE WHEN vif > 10 THEN 'bad' WHEN vif > 5 THEN 'warn' ELSE 'ok' END AS severity, CASE WHEN vif > 10 THEN "
        "'High (>10)' WHEN vif > 5 THEN 'Moderate (5-10)' ELSE 'Low (<= 5)' END AS message FROM v"),
    "findings_condition_number_lineitem": (
        lambda s, d: rounded(fd.condition_findings(regression.condition_number(_lineitem(s, d), ["l_discount"])), value=6),
        "WITH g AS (SELECT count(*)::DOUBLE AS n, sum(l_discount) AS s, sum(l_discount * l_discount) AS ss FROM lineitem), "
        "e AS (SELECT (n + ss) / 2 AS h, sqrt(pow((n - ss) / 2, 2) + s * s) AS w FROM g), "
        "c AS (SELECT sqrt((h + w) / (h - w)) AS v FROM e) SELECT 'condition_number' AS operator, 'design' AS subject, "
        "'condition_number' AS metric, round(v, 6) AS value, CASE WHEN v > 30 THEN 'bad' WHEN v > 15 THEN 'warn' ELSE 'ok' END "
        "AS severity, CASE WHEN v > 30 THEN 'Severe (> 30)' WHEN v > 15 THEN 'Moderate (15-30)' ELSE 'Low (<= 15)' END "
        "AS message FROM c"),
    "findings_white_test_lineitem": (
        lambda s, d: rounded(fd.heteroskedasticity_findings(regression.heteroskedasticity(
            _lineitem(s, d), "l_extendedprice", ["l_quantity"]).where("test = 'white'")), value=8),
        f"WITH {FIT}, p AS (SELECT exp(-n * rsq / 2) AS p FROM t WHERE test = 'white') SELECT 'heteroskedasticity' AS operator, "
        "'white' AS subject, 'lm_p' AS metric, round(p, 8) AS value, CASE WHEN p < 0.05 THEN 'bad' ELSE 'ok' END AS severity, "
        "CASE WHEN p < 0.05 THEN 'Heteroskedastic' ELSE 'Homoskedastic' END AS message FROM p"),
    "findings_frequency_orders": (
        lambda s, d: fd.frequency_findings(dates.frequency(_runs(s, d), "D"), ["o_orderpriority"]),
        f"WITH {STEPS}, {HIST}, c AS (SELECT o_orderpriority AS subject, count(*) = 1 AS reg, first(delta ORDER BY n DESC, delta) = 1 "
        "AS fit FROM h GROUP BY 1) SELECT 'frequency' AS operator, subject, 'is_regular' AS metric, reg::INT::DOUBLE AS value, "
        "CASE WHEN reg THEN 'ok' ELSE 'bad' END AS severity, CASE WHEN reg THEN 'Regular series' ELSE 'Irregular series' END "
        "AS message FROM c UNION ALL SELECT 'frequency', subject, 'expected_match', fit::INT::DOUBLE, "
        "CASE WHEN fit THEN 'ok' ELSE 'bad' END, CASE WHEN fit THEN 'Matches expected frequency' ELSE "
        "'Differs from expected frequency' END FROM c"),
    "findings_ljung_box_daily": (
        lambda s, d: rounded(fd.ljung_box_findings(autocorrelation.ljung_box(daily_series(s, d)), ["series"]), value=8),
        f"WITH {DAILY}, {LAGGED}, {COVS}, {ACF}, {LB}, p AS (SELECT {P12} AS p FROM q) SELECT 'ljung_box' AS operator, "
        "'total' AS subject, 'p_value' AS metric, round(p, 8) AS value, CASE WHEN p < 0.05 THEN 'bad' ELSE 'ok' END AS severity, "
        "CASE WHEN p < 0.05 THEN 'Autocorrelation detected' ELSE 'No significant autocorrelation' END AS message FROM p"),
    "findings_p_values_lineitem": (
        lambda s, d: rounded(fd.p_values(describe.jarque_bera(_lineitem(s, d), NUM), "jarque_bera", F.col("column"),
                                         F.col("test")).drop("message"), value=8),
        f"WITH {CELLS}, {MOMENTS}, j AS (SELECT \"column\", exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + "
        "pow(m4 / (m2 * m2) - 3, 2) / 4)) AS p FROM m) SELECT 'jarque_bera' AS operator, \"column\" AS subject, "
        "'jarque_bera' AS metric, round(p, 8) AS value, CASE WHEN p < 0.05 THEN 'bad' WHEN p < 0.1 THEN 'warn' ELSE 'ok' END "
        "AS severity FROM j"),
    "findings_normality_lineitem": (
        lambda s, d: rounded(fd.normality_findings(describe.jarque_bera(_lineitem(s, d), NUM)), value=8),
        f"WITH {CELLS}, {MOMENTS}, j AS (SELECT \"column\", exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + "
        "pow(m4 / (m2 * m2) - 3, 2) / 4)) AS p FROM m) SELECT 'normality' AS operator, \"column\" AS subject, "
        "'jarque_bera' AS metric, round(p, 8) AS value, CASE WHEN p >= 0.05 THEN 'ok' ELSE 'bad' END AS severity, "
        "CASE WHEN p >= 0.05 THEN 'Normal' ELSE 'Non-normal' END AS message FROM j"),
    "findings_correlation_lineitem": (
        lambda s, d: fd.correlation_findings(describe.correlation(_lineitem(s, d), PAIR)),
        " UNION ALL ".join(
            f"SELECT 'correlation' AS operator, '{a} / {b}' AS subject, 'pearson' AS metric, round(r, 4) + 0.0 AS value, "
            "CASE WHEN abs(round(r, 4)) >= 0.7 THEN 'bad' WHEN abs(round(r, 4)) >= 0.4 THEN 'warn' ELSE 'ok' END AS severity, "
            "CASE WHEN abs(round(r, 4)) >= 0.7 THEN 'Strong' WHEN abs(round(r, 4)) >= 0.4 THEN 'Moderate' ELSE 'Weak' END "
            f"AS message FROM (SELECT corr({a}, {b}) AS r FROM lineitem)"
            for a in sorted(PAIR) for b in sorted(PAIR) if a < b)),
    "findings_panel_balance_orders": (
        lambda s, d: fd.balance_findings(panel.balance(table(s, d, "orders"), "o_orderpriority", "o_orderdate")),
        "WITH b AS (SELECT count(DISTINCT o_orderpriority) * count(DISTINCT o_orderdate) AS e, "
        "count(DISTINCT (o_orderpriority, o_orderdate)) AS a FROM orders) SELECT 'panel_balance' AS operator, "
        "'panel' AS subject, 'balance_ratio' AS metric, round(a::DOUBLE / e, 4) AS value, "
        "CASE WHEN a = e THEN 'ok' ELSE 'bad' END AS severity, CASE WHEN a = e THEN 'Balanced' ELSE 'Unbalanced' END AS message FROM b"),
    "findings_executive_cards": (
        lambda s, d: fd.executive_cards(missing.missing_total(holes(s, d)), duplicates.duplicate_rates(order_flags(s, d))),
        f"WITH {HOLES}, {PER_ROW}, {ORDER_GROUPS}, v AS (SELECT round(sum(m) * 100.0 / (count(*) * 6), 4) AS miss, "
        "round(count(*) FILTER (m = 0) * 100.0 / count(*), 2) AS comp, (SELECT round(count(*) FILTER (dup) * 100.0 / count(*), 4) "
        "FROM f) AS dup FROM m) SELECT 'summary' AS operator, 'table' AS subject, 'missing_percentage' AS metric, miss AS value, "
        "CASE WHEN miss <= 1 THEN 'ok' WHEN miss <= 10 THEN 'warn' ELSE 'bad' END AS severity, 'Missing cells in percent' AS message "
        "FROM v UNION ALL SELECT 'summary', 'table', 'complete_row_percentage', comp, CASE WHEN comp >= 90 THEN 'ok' "
        "WHEN comp >= 70 THEN 'warn' ELSE 'bad' END, 'Complete rows in percent' FROM v UNION ALL SELECT 'summary', 'table', "
        "'duplicate_percentage', dup, CASE WHEN dup <= 0.5 THEN 'ok' WHEN dup <= 5 THEN 'warn' ELSE 'bad' END, "
        "'Duplicate rows in percent' FROM v"),
    "findings_stationarity_events": (
        lambda s, d: fd.stationarity_findings(stationarity.stationarity(_event_series(s, d)), ["event_type", "series"]), None),
    "findings_seasonal_strength_events": (
        lambda s, d: fd.seasonal_findings(seasonal.seasonal_strength(_event_series(s, d), 7), ["event_type", "series"]), None),
    "findings_arch_events": (
        lambda s, d: fd.arch_findings(autocorrelation.arch_lm(_event_series(s, d)), ["event_type", "series"]), None),
    "findings_breaks_events": (
        lambda s, d: fd.break_findings(breaks.break_tests(_event_series(s, d)), ["event_type", "series"]), None),
    "findings_executive_alerts_daily": (
        lambda s, d: (lambda x: fd.executive_alerts(stationarity.stationarity(x), breaks.break_tests(x), ["series"], "total"))(
            daily_series(s, d)), None),
}
