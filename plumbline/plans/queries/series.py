"""Time-series statistics and structural breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.series import build_series
from plumbline.operators import autocorrelation, breaks, feeds, seasonal, stationarity
from plumbline.plans.queries.common import (DAILY, MONTHLY, as_text, daily_series, monthly_series, rounded, table)

LAGGED = "l AS (SELECT *, y - mean AS v, " + ", ".join(
    f"lag(y - mean, {k}) OVER (ORDER BY t) AS l{k}" for k in range(1, 13)) + " FROM s)"
COVS = "c AS (SELECT max(n) AS n, sum(v * v) AS c0, " + ", ".join(
    f"sum(v * l{k}) AS c{k}" for k in range(1, 13)) + " FROM l)"
ACF = "a AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, c{k} / c0 AS r, n FROM c" for k in range(13)) + ")"
LB = "q AS (SELECT max(n) AS n, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) FILTER (lag > 0) AS q FROM a)"
# Durbin-Levinson over the adjusted autocovariances, one step per row.
PACF = """cov AS (SELECT list(r / (n - lag) ORDER BY lag) AS g FROM a),
dl AS (SELECT 0 AS k, []::DOUBLE[] AS phi, (SELECT g[1] FROM cov) AS v, 1.0::DOUBLE AS p
UNION ALL SELECT k + 1, list_transform(range(1, k + 1), lambda j: phi[j] - ref * phi[k + 1 - j]) || [ref],
 v * (1 - ref * ref), ref FROM (SELECT k, phi, v, (g[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1),
 lambda j: phi[j] * g[k + 2 - j])), 0)) / v AS ref FROM dl, cov WHERE k < 12))"""

LONG_RUN = """lags AS (SELECT unnest(generate_series(1, (SELECT ceil(12 * pow(max(n) / 100.0, 0.25))::BIGINT FROM e))) AS k),
g AS (SELECT k, sum(a.r * b.r) AS g FROM lags, e a, e b WHERE b.t = a.t - k GROUP BY 1),
lr AS (SELECT ((SELECT sum(r * r) FROM e) + 2 * sum(g * (1 - k / (m + 1.0)))) / (SELECT count(*) FROM e) AS lr, max(m) AS m
 FROM g, (SELECT max(k) AS m FROM lags))"""
KPSS = """eta AS (SELECT sum(p * p) / pow(max(n), 2) AS eta, max(n) AS n FROM
 (SELECT n, sum(r) OVER (ORDER BY t) AS p FROM e)), k AS (SELECT eta / lr AS stat, m, n FROM eta, lr)"""


def _kpss_sql(resid: str, crit: list[float], test: str) -> str:
    probs = [0.10, 0.05, 0.025, 0.01]
    p = f"CASE WHEN stat <= {crit[0]} THEN 0.1 " + " ".join(
        f"WHEN stat <= {crit[i + 1]} THEN {probs[i]} + ({probs[i + 1]} - {probs[i]}) * (stat - {crit[i]}) / "
        f"({crit[i + 1]} - {crit[i]})" for i in range(3)) + " ELSE 0.01 END"
    return (f"WITH {DAILY}, b AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s), "
            f"e AS (SELECT t, n, {resid} AS r FROM s, b), {LONG_RUN}, {KPSS} SELECT '{test}' AS test, "
            f"round(stat, 8) AS statistic, round({p}, 8) AS p_value, m AS lags, n AS n_obs, {p} > 0.05 AS stationary FROM k")


def _kpss(s, d, regression):
    return rounded(stationarity.kpss(daily_series(s, d), regression).select(
        "test", "statistic", "p_value", "lags", "n_obs", "stationary"), statistic=8, p_value=8)


# Dickey-Fuller regression without lags, and its residuals.
DF = """w AS (SELECT t, n, y - mean AS x, lag(y - mean) OVER (ORDER BY t) AS x1 FROM s),
f AS (SELECT regr_slope(x - x1, x1) AS b, regr_intercept(x - x1, x1) AS a, count(x1) AS m,
 regr_sxx(x - x1, x1) AS sxx, regr_syy(x - x1, x1) * (1 - regr_r2(x - x1, x1)) AS rss FROM w)"""
# Evenly spaced splits, cut to whole numbers.
SPLITS = """k AS (SELECT i AS candidate, CASE WHEN i = {last} THEN n - m ELSE floor(i * ((n - 2 * m) / {last}.0) + m)::BIGINT END
 AS split FROM (SELECT max(n) AS n, greatest({least}, floor(max(n) * 0.1)::BIGINT) AS m FROM s),
 (SELECT unnest(range({count})) AS i))"""
CHOW = SPLITS.format(last=19, least=10, count=20) + """,
z AS (SELECT t, n, t - (n - 1) / 2.0 AS tc, y - (SELECT regr_slope(y, t) FROM s) * t
 - (SELECT regr_intercept(y, t) FROM s) AS r FROM s),
p AS (SELECT candidate, split, max(n) AS n,
 regr_syy(r, tc) FILTER (t < split) * (1 - coalesce(regr_r2(r, tc) FILTER (t < split), 0)) AS rss1,
 regr_syy(r, tc) FILTER (t >= split) * (1 - coalesce(regr_r2(r, tc) FILTER (t >= split), 0)) AS rss2,
 sum(r * r) AS rss FROM k, z GROUP BY ALL),
f AS (SELECT *, ((rss - rss1 - rss2) / 2) / ((rss1 + rss2) / (n - 4)) AS f FROM p),
o AS (SELECT *, pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0) AS pv FROM f)"""
SHIFT = SPLITS.format(last=49, least=5, count=50) + """,
p AS (SELECT min(candidate) AS candidate, split, max(n) AS n, avg(y) FILTER (t < split) AS m1,
 avg(y) FILTER (t >= split) AS m2, var_samp(y) FILTER (t < split) / split AS v1,
 var_samp(y) FILTER (t >= split) / (max(n) - split) AS v2 FROM (SELECT split, min(candidate) AS candidate FROM k GROUP BY 1), s
 GROUP BY split),
f AS (SELECT *, (m1 - m2) / sqrt(v1 + v2) AS t, pow(v1 + v2, 2) / (v1 * v1 / (split - 1) + v2 * v2 / (n - split - 1)) AS df FROM p)"""
CUSUM = """z AS (SELECT t, n, ts, y, regr_slope(y, t) OVER w AS b, regr_intercept(y, t) OVER w AS a FROM s
 WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT t, n, ts, y - a - b * t AS r FROM z WHERE t >= 3),
c AS (SELECT t, n, ts, r, sum(r) OVER (ORDER BY t) / (SELECT stddev_samp(r) FROM e) / sqrt((SELECT count(*) FROM e)) AS c FROM e)"""


def _bai_perron_sql(tail: str) -> str:
    """Optimal mean breaks of the monthly totals over every point."""
    steps = ["""x AS (SELECT t, n, y - mean AS v FROM s),
z AS (SELECT max(n) AS n, greatest(3, floor(max(n) * 0.1)::BIGINT) AS size,
 least(5, greatest(1, max(n) // greatest(5, floor(max(n) * 0.1)::BIGINT) - 1)) AS top FROM x),
pre AS (SELECT 0 AS j, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
 SELECT t + 1, sum(v) OVER (ORDER BY t), sum(v * v) OVER (ORDER BY t) FROM x),
f0 AS (SELECT j, b - a * a / j AS f, []::BIGINT[] AS path FROM pre, z WHERE j >= size)"""]
    for k in range(1, 6):
        steps.append(f"""f{k} AS (SELECT q.j, min(f + q.b - p.b - pow(q.a - p.a, 2) / (q.j - p.j)) AS f,
 first(path || [p.j] ORDER BY f + q.b - p.b - pow(q.a - p.a, 2) / (q.j - p.j), p.j) AS path
 FROM f{k - 1} JOIN pre p USING (j), pre q, z WHERE q.j - p.j >= size AND p.j >= {k} * size AND {k} <= top GROUP BY q.j)""")
    ends = " UNION ALL ".join(f"SELECT {k} AS k, f, path FROM f{k}, z WHERE j = n" for k in range(6))
    return (f"WITH {MONTHLY}, " + ", ".join(steps) + f", ends AS ({ends}), "
            "bic AS (SELECT k, f, path, n * ln(f / n) + k * ln(n) AS bic, n FROM ends, z WHERE f > 0), "
            f"best AS (SELECT * FROM bic ORDER BY bic, k LIMIT 1) {tail}")


def _stepped(s, d):
    """Monthly totals with a level shift in the year 1998, so that breaks are found."""
    from plumbline.plans.queries.common import monthly_orders
    df = monthly_orders(s, d).withColumn("total", F.col("total") * F.when(F.col("month") >= "1998-01-01", 1.5).otherwise(1.0))
    return build_series(df, "month", ["total"])


STEPPED_SQL = ("sum(o_totalprice) AS y FROM orders GROUP BY 1",
               "sum(o_totalprice) * CASE WHEN date_trunc('month', o_orderdate) >= DATE '1998-01-01' THEN 1.5 ELSE 1.0 END "
               "AS y FROM orders GROUP BY 1, date_trunc('month', o_orderdate)")


def _event_series(s, d):
    df = table(s, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_events"))
    return build_series(df, "day", ["total", "n_events"], ["event_type"])


# 1 = squared series on its previous value only.
ARCH1 = """v AS (SELECT y * y - mean * mean AS v, lag(y * y - mean * mean) OVER (ORDER BY t) AS v1 FROM s),
r AS (SELECT corr(v, v1) * corr(v, v1) AS r2, count(v1) AS m, count(*) AS n FROM v)"""
EVENTS = """e AS (SELECT event_type, date_trunc('day', ts) AS ts, sum(value) AS total, count(*)::DOUBLE AS n_events
FROM events GROUP BY ALL), u AS (SELECT event_type, ts, 'total' AS series, total AS y FROM e UNION ALL
SELECT event_type, ts, 'n_events', n_events FROM e),
s AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER p AS n, avg(y) OVER p AS mean FROM u
 WINDOW w AS (PARTITION BY event_type, series ORDER BY ts), p AS (PARTITION BY event_type, series))"""
EVENT_ACF = ("l AS (SELECT *, y - mean AS v, " + ", ".join(
    f"lag(y - mean, {k}) OVER (PARTITION BY event_type, series ORDER BY t) AS l{k}" for k in range(1, 13))
    + " FROM s), c AS (SELECT event_type, series, max(n) AS n, sum(v * v) AS c0, " + ", ".join(
    f"sum(v * l{k}) AS c{k}" for k in range(1, 13)) + " FROM l GROUP BY ALL), q AS (SELECT event_type, series, n, "
    "n * (n + 2) * (" + " + ".join(f"pow(c{k} / c0, 2) / (n - {k})" for k in range(1, 13)) + ") AS q FROM c)")
P12 = "exp(-q / 2) * (" + " + ".join(f"pow(q / 2, {j}) / {f}" for j, f in enumerate((1, 1, 2, 6, 24, 120))) + ")"

QUERIES = {
    "ordered_series_daily": (
        lambda s, d: as_text(rounded(daily_series(s, d).rows.select("t", "ts", "y", "n", "mean", "slope"),
                                     y=2, mean=4, slope=6), "ts"),
        f"WITH {DAILY} SELECT t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(y, 2) AS y, n, round(mean, 4) AS mean, "
        "round(regr_slope(y, t) OVER (), 6) + 0.0 AS slope FROM s"),
    "acf_daily": (
        lambda s, d: rounded(autocorrelation.acf(daily_series(s, d)).select("lag", "acf", "n"), acf=8),
        f"WITH {DAILY}, {LAGGED}, {COVS}, {ACF} SELECT lag, round(r, 8) + 0.0 AS acf, n FROM a"),
    "pacf_daily": (
        lambda s, d: rounded(autocorrelation.acf(daily_series(s, d)).select("lag", "pacf"), pacf=8),
        f"WITH RECURSIVE {DAILY}, {LAGGED}, {COVS}, {ACF}, {PACF} SELECT k AS lag, round(p, 8) + 0.0 AS pacf FROM dl"),
    "ljung_box_daily": (
        lambda s, d: rounded(autocorrelation.ljung_box(daily_series(s, d)).select("lag", "statistic", "p_value", "n"),
                             statistic=8, p_value=8),
        f"WITH {DAILY}, {LAGGED}, {COVS}, {ACF}, {LB} SELECT 12 AS lag, round(q, 8) AS statistic, "
        f"round({P12}, 8) AS p_value, n FROM q"),
    "ljung_box_events_panel": (
        lambda s, d: rounded(autocorrelation.ljung_box(_event_series(s, d)).drop("error", "lag"), statistic=8, p_value=8),
        f"WITH {EVENTS}, {EVENT_ACF} SELECT event_type, series, round(q, 8) AS statistic, round({P12}, 8) AS p_value, n FROM q"),
    "arch_lm_one_lag_daily": (
        lambda s, d: rounded(autocorrelation.arch_lm(daily_series(s, d), lags=1).select("lags", "n", "lm", "f"), lm=6, f=6),
        f"WITH {DAILY}, {ARCH1} SELECT 1 AS lags, n, round(m * r2, 6) AS lm, round(r2 / ((1 - r2) / (m - 2)), 6) AS f FROM r"),
    "arch_lm_daily": (lambda s, d: autocorrelation.arch_lm(daily_series(s, d)), None),
    "arch_lm_events_panel": (lambda s, d: autocorrelation.arch_lm(_event_series(s, d)), None),
    "adf_no_lags_daily": (
        lambda s, d: rounded(stationarity.adf(daily_series(s, d), lags=0).select("test", "statistic", "lags", "n_obs"),
                             statistic=6),
        f"WITH {DAILY}, {DF} SELECT 'adf' AS test, round(b / sqrt(rss / (m - 2) / sxx), 6) AS statistic, 0 AS lags, "
        "m AS n_obs FROM f"),
    "adf_daily": (lambda s, d: stationarity.adf(daily_series(s, d)), None),
    "kpss_level_daily": (lambda s, d: _kpss(s, d, "c"),
                         _kpss_sql("y - mean", [0.347, 0.463, 0.574, 0.739], "kpss_level")),
    "kpss_trend_daily": (lambda s, d: _kpss(s, d, "ct"),
                         _kpss_sql("y - a - b * t", [0.119, 0.146, 0.176, 0.216], "kpss_trend")),
    "phillips_perron_daily": (
        lambda s, d: rounded(stationarity.phillips_perron(daily_series(s, d)).select("test", "statistic", "lags", "n_obs"),
                             statistic=5),
        f"WITH {DAILY}, {DF}, e AS (SELECT t, n, x - x1 - a - b * x1 AS r FROM w, f WHERE x1 IS NOT NULL), {LONG_RUN}, "
        "o AS (SELECT b / sqrt(rss / (f.m - 2) / sxx) AS tb, sqrt(rss / (f.m - 2) / sxx) AS se, sqrt(rss / (f.m - 2)) AS s, "
        "rss / f.m AS g0, lr, f.m AS nobs, lr.m AS lags FROM f, lr) SELECT 'pp' AS test, round(sqrt(g0 / lr) * tb - "
        "0.5 * (lr - g0) / sqrt(lr) * (nobs * se / s), 5) AS statistic, lags, nobs AS n_obs FROM o"),
    "stationarity_daily": (lambda s, d: stationarity.stationarity(daily_series(s, d)).drop("critical_values"), None),
    "stationarity_events_panel": (
        lambda s, d: stationarity.stationarity(_event_series(s, d)).drop("critical_values"), None),
    "stl_monthly": (lambda s, d: seasonal.stl(monthly_series(s, d), 12), None),
    "seasonal_strength_events_panel": (lambda s, d: seasonal.seasonal_strength(_event_series(s, d), 7), None),
    "chow_scan_daily": (
        lambda s, d: rounded(breaks.chow_scan(daily_series(s, d)).select(
            "candidate", "break_index", "f", "p_value", "significant", "n"), f=6, p_value=8),
        f"WITH {DAILY}, {CHOW} SELECT candidate, split AS break_index, round(f, 6) AS f, round(pv, 8) AS p_value, "
        "pv < 0.05 AS significant, n FROM o"),
    "chow_best_daily": (
        lambda s, d: as_text(rounded(breaks.chow(daily_series(s, d)).select("break_index", "break_ts", "f", "p_value"),
                                     f=6, p_value=8), "break_ts"),
        f"WITH {DAILY}, {CHOW} SELECT split AS break_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS break_ts, "
        "round(f, 6) AS f, round(pv, 8) AS p_value FROM o JOIN s ON s.t = split ORDER BY o.f DESC, candidate LIMIT 1"),
    "chow_at_split_monthly": (
        lambda s, d: rounded(breaks.chow_at(monthly_series(s, d), 36).select("break_index", "f", "p_value", "n"),
                             f=6, p_value=8),
        f"WITH {MONTHLY}, " + CHOW.replace(SPLITS.format(last=19, least=10, count=20),
                                           "k AS (SELECT 0 AS candidate, 36 AS split)")
        + " SELECT split AS break_index, round(f, 6) AS f, round(pv, 8) AS p_value, n FROM o"),
    "mean_shift_scan_daily": (
        lambda s, d: rounded(breaks.mean_shift_scan(daily_series(s, d)).select(
            "break_index", "t", "df", "mean_before", "mean_after"), t=6, df=4, mean_before=3, mean_after=3),
        f"WITH {DAILY}, {SHIFT} SELECT split AS break_index, round(t, 6) + 0.0 AS t, round(df, 4) AS df, "
        "round(m1, 3) AS mean_before, round(m2, 3) AS mean_after FROM f"),
    "mean_shift_best_daily": (
        lambda s, d: as_text(rounded(breaks.mean_shift(daily_series(s, d)).select(
            "break_index", "break_ts", "t", "shift_magnitude"), t=6, shift_magnitude=3), "break_ts"),
        f"WITH {DAILY}, {SHIFT} SELECT split AS break_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS break_ts, "
        "round(f.t, 6) AS t, round(m2 - m1, 3) AS shift_magnitude FROM f JOIN s ON s.t = split "
        "ORDER BY abs(f.t) DESC, candidate LIMIT 1"),
    "before_after_means_daily": (
        lambda s, d: rounded(feeds.before_after(daily_series(s, d)).select(
            "break_index", "mean_before", "mean_after", "shift_magnitude"), mean_before=3, mean_after=3, shift_magnitude=3),
        f"WITH {DAILY}, {SHIFT} SELECT split AS break_index, round(m1, 3) AS mean_before, round(m2, 3) AS mean_after, "
        "round(m2 - m1, 3) AS shift_magnitude FROM f ORDER BY abs(f.t) DESC, candidate LIMIT 1"),
    "cusum_path_daily": (
        lambda s, d: rounded(breaks.cusum_path(daily_series(s, d)).select("t", "cusum"), cusum=6),
        f"WITH {DAILY}, {CUSUM} SELECT t, round(c, 6) + 0.0 AS cusum FROM c"),
    "cusum_daily": (
        lambda s, d: as_text(rounded(breaks.cusum(daily_series(s, d)).select(
            "max_cusum", "break_index", "break_ts", "rejects_stability", "n_recursive_residuals"), max_cusum=6), "break_ts"),
        f"WITH {DAILY}, {CUSUM} SELECT round(abs(c), 6) AS max_cusum, t AS break_index, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS break_ts, abs(c) > 0.948 AS rejects_stability, "
        "n - 3 AS n_recursive_residuals FROM c ORDER BY abs(c) DESC, t LIMIT 1"),
    "cusum_curve_daily": (
        lambda s, d: rounded(feeds.cusum_curve(daily_series(s, d)).select("t", "cusum", "boundary"), cusum=6),
        f"WITH {DAILY}, {CUSUM} SELECT t, round(c, 6) + 0.0 AS cusum, 0.948::DOUBLE AS boundary FROM c "
        "WHERE (t - 3) % CASE WHEN n - 3 > 500 THEN (n - 3) // 500 ELSE 1 END = 0"),
    "chow_curve_monthly": (
        lambda s, d: rounded(feeds.chow_curve(monthly_series(s, d)).select("candidate", "break_index", "f", "p_value"),
                             f=6, p_value=8),
        f"WITH {MONTHLY}, {CHOW} SELECT candidate, split AS break_index, round(f, 6) AS f, round(pv, 8) AS p_value FROM o"),
    "zivot_andrews_daily": (lambda s, d: breaks.zivot_andrews(daily_series(s, d)).drop("critical_values"), None),
    "bai_perron_monthly": (
        lambda s, d: rounded(breaks.bai_perron_table(_stepped(s, d)).select(
            "n_breaks", F.concat_ws(",", F.col("break_indices").cast("array<string>")).alias("break_indices"), "bic",
            "selected"), bic=6),
        _bai_perron_sql("SELECT k AS n_breaks, array_to_string(path, ',') AS break_indices, round(bic, 6) AS bic, "
                        "k = (SELECT k FROM best) AS selected FROM bic").replace(*STEPPED_SQL)),
    "bai_perron_segments_monthly": (
        lambda s, d: as_text(rounded((lambda x: breaks.bai_perron_segments(x, breaks.bai_perron_table(x)))(
            _stepped(s, d)).drop("series"), mean=2, std=2), "start_ts", "end_ts"),
        _bai_perron_sql("SELECT len(list_filter(path, lambda b: b <= t)) AS segment, min(t) AS start_index, max(t) AS end_index, "
                        "strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, "
                        "count(*) AS n_obs, round(avg(y), 2) AS mean, round(stddev_samp(y), 2) AS std "
                        "FROM s, best GROUP BY 1").replace(*STEPPED_SQL)),
    "bai_perron_breaks_monthly": (
        lambda s, d: as_text((lambda x: breaks.bai_perron_breaks(x, breaks.bai_perron_table(x)))(
            _stepped(s, d)).select("break_no", "break_index", "break_ts"), "break_ts"),
        _bai_perron_sql("SELECT u.i - 1 AS break_no, path[u.i] AS break_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS break_ts "
                        "FROM best, (SELECT unnest(range(1, 6)) AS i) u JOIN s ON true WHERE u.i <= len(path) AND s.t = path[u.i]"
                        ).replace(*STEPPED_SQL)),
    "bic_curve_monthly": (
        lambda s, d: feeds.bic_curve(_stepped(s, d)).select("n_breaks", "bic"),
        _bai_perron_sql("SELECT k AS n_breaks, round(bic, 4) AS bic FROM bic").replace(*STEPPED_SQL)),
    "break_tests_monthly": (lambda s, d: breaks.break_tests(_stepped(s, d)), None),
    "detected_breaks_events_panel": (
        lambda s, d: breaks.detected_breaks(breaks.break_tests(_event_series(s, d))), None),
    "thinned_series_daily": (
        lambda s, d: as_text(rounded(feeds.thinned(daily_series(s, d), 500).select("t", "ts", "y"), y=2), "ts"),
        f"WITH {DAILY} SELECT t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(y, 2) AS y FROM s "
        "WHERE t % CASE WHEN n > 500 THEN n // 500 ELSE 1 END = 0"),
}
