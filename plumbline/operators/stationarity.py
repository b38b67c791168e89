"""Unit-root and stationarity tests for every series at once: ADF, KPSS, Phillips-Perron.

What a regression on lagged differences needs of a series is a set of lag
products plus a few values at both ends, so one pass over the blocks gives
every lag order; the regressions themselves are small and run one per series
inside Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.critical import (KPSS_CRITICAL, KPSS_P, adf_critical, adf_p_value)
from plumbline.functions.lags import key_fields, lag_arrays, lag_products, long_lag
from plumbline.functions.series import Series, running_sums, with_halo
from plumbline.functions.tables import write_table

MIN_ROWS = 10
RESULT = [("statistic", T.DoubleType()), ("p_value", T.DoubleType()), ("lags", T.IntegerType()),
          ("n_obs", T.LongType()), ("stationary", T.BooleanType()),
          ("critical_values", T.MapType(T.StringType(), T.DoubleType())), ("error", T.StringType())]


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*key_fields(df, keys), T.StructField("test", T.StringType()),
                         *[T.StructField(c, t) for c, t in RESULT]])


def _frame(pdf: pd.DataFrame, keys: list[str], test: str, results: list[dict]) -> pd.DataFrame:
    out = pdf[[*keys]].reset_index(drop=True)
    out["test"] = test
    for name, kind in RESULT:
        values = [r.get(name) for r in results]
        if isinstance(kind, T.DoubleType):
            out[name] = np.array([np.nan if v is None else v for v in values], float)
        elif isinstance(kind, T.BooleanType):
            out[name] = pd.array(values, dtype="boolean")
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            out[name] = pd.array(values, dtype="Int64")
        else:
            out[name] = values
    return out


def difference_moments(series: Series) -> DataFrame:
    """One row per series: sums and lag products of levels and differences, and both ends.

    keys, n, max_lag, c (difference x difference), e (level x earlier
    difference), d1 (difference x previous level), sx, sxx, stx, std, head, tail.
    Levels are demeaned and time is centred and divided by n.
    """
    keys = series.keys
    rows = series.rows.select(*keys, "block", "t", "n", series.demeaned().alias("x")).withColumn(
        "max_lag", F.greatest(F.least(long_lag(F.col("n")), F.floor(F.col("n") / 2) - 2), F.lit(0)).cast("int"))
    halo = with_halo(series, rows, F.col("max_lag") + 1)
    inside = W.partitionBy(*keys, "block").orderBy("t")
    before = F.lag("x").over(inside)
    halo = halo.withColumn("x1", F.coalesce(before, F.lit(0.0))).withColumn(
        "d", F.when(F.col("t") > 0, F.coalesce(F.col("x") - before, F.lit(0.0))).otherwise(0.0))
    products = lag_arrays(lag_products(series, halo, [("d", "d"), ("x", "d")], "max_lag"), keys, 2)
    tau = (F.col("t") - (F.col("n") - 1) / 2.0) / F.col("n")
    sums = halo.where("core").groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("max_lag").alias("max_lag"),
        F.sum(F.col("d") * F.col("x1")).alias("d1"), F.sum("x").alias("sx"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(tau * F.col("x")).alias("stx"),
        F.sum(tau * F.col("d")).alias("std"))
    near = F.col("max_lag") + 2
    at = F.struct("t", "x")
    ends = rows.where((F.col("t") < near) | (F.col("t") >= F.col("n") - near)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("t") < near, at))).alias("_h"),
        F.sort_array(F.collect_list(F.when(F.col("t") >= F.col("n") - near, at))).alias("_t"))
    return sums.join(products, keys).join(ends, keys).select(
        *keys, "n", "max_lag", F.col("p0").alias("c"), F.col("p1").alias("e"), "d1", "sx", "sxx", "stx",
        "std", F.col("_h.x").alias("head"), F.col("_t.x").alias("tail"))


class Moments:
    """Cross products of a lagged-difference regression of any lag order up to ``max_lag``."""

    def __init__(self, row):
        self.n, self.top = int(row.n), int(row.max_lag)
        self.c, self.e = np.asarray(row.c, float), np.asarray(row.e, float)
        self.d1, self.sx, self.sxx, self.stx, self.std = row.d1, row.sx, row.sxx, row.stx, row.std
        self.head, self.tail = np.asarray(row.head, float), np.asarray(row.tail, float)

    def level(self, s: int) -> float:
        """Demeaned level at position s; only near the ends, zero outside the series."""
        if 0 <= s < len(self.head):
            return self.head[s]
        at = s - (self.n - len(self.tail))
        return self.tail[at] if 0 <= at < len(self.tail) and s < self.n else 0.0

    def diff(self, s: int) -> float:
        return self.level(s) - self.level(s - 1) if 1 <= s < self.n else 0.0

    def tau(self, t):
        return (t - (self.n - 1) / 2.0) / self.n

    def _rows(self, times, p: int) -> np.ndarray:
        """Regressor rows [1, time, level before, difference, p earlier differences]."""
        return np.array([[1.0, self.tau(t), self.level(t - 1), *[self.diff(t - a) for a in range(p + 1)]]
                         for t in times]).reshape(-1, p + 4)

    def gramian(self, p: int) -> np.ndarray:
        """Products of [1, time, level before, difference, p lags] over t = p+1 .. n-1.

        Sums over the zero-extended series depend on the lag distance only; the
        rows before t = p+1 and after t = n-1 are then taken off again.
        """
        n = self.n
        total = n + p
        g = np.zeros((p + 4, p + 4))
        ends = self.level(n - 1) - self.level(0)
        s1 = total * (total + 1) / 2.0
        s2 = total * (total + 1) * (2 * total + 1) / 6.0
        mid = (n - 1) / 2.0
        g[0, 0], g[0, 1], g[0, 2] = total, (s1 - mid * total) / n, self.sx
        g[1, 1] = (s2 - 2 * mid * s1 + mid * mid * total) / n**2
        g[1, 2], g[2, 2] = self.stx + self.sx / n, self.sxx
        for a in range(p + 1):
            g[0, 3 + a] = ends
            g[1, 3 + a] = self.std + a / n * ends
            g[2, 3 + a] = self.d1 if a == 0 else self.e[a - 1]
            for b in range(a, p + 1):
                g[3 + a, 3 + b] = self.c[b - a]
        g = np.triu(g) + np.triu(g, 1).T
        for times in (range(1, p + 1), range(n, n + p + 1)):
            m = self._rows(times, p)
            g -= m.T @ m
        return g

    def lag_by_aic(self, regression: str, max_lag: int) -> int:
        """Lag order with the smallest AIC on the common sample; the smallest on ties."""
        g = self.gramian(max_lag)
        order = [0, *([1] if regression == "ct" else []), 2, *range(4, max_lag + 4), 3]
        base = len(order) - max_lag - 1
        rss = _nested_rss(g[np.ix_(order, order)])
        nobs = self.n - 1 - max_lag
        aic = [nobs * (np.log(2 * np.pi) + np.log(max(rss[base + j], 1e-300) / nobs) + 1) + 2 * (base + j)
               for j in range(max_lag + 1)]
        return int(np.argmin(aic))

    def level_t(self, regression: str, p: int) -> tuple[float, float, float, np.ndarray]:
        """t ratio of the level, residual sum of squares, its standard error, coefficients."""
        g = self.gramian(p)
        cols = [0, *([1] if regression == "ct" else []), 2, *range(4, p + 4)]
        a, b, yy = g[np.ix_(cols, cols)], g[cols, 3], g[3, 3]
        inv = _scaled_inverse(a)
        beta = inv @ b
        rss = float(yy - beta @ b)
        at = cols.index(2)
        dof = self.n - 1 - p - len(cols)
        se = float(np.sqrt(rss / dof * inv[at, at])) if dof > 0 and rss > 0 else float("nan")
        return float(beta[at]) / se if se > 0 else float("nan"), rss, se, beta


def _scaled_inverse(a: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-13, hermitian=True) / np.outer(d, d)


def _nested_rss(g: np.ndarray) -> np.ndarray:
    """Residual sums of the last column on the first 0, 1, 2, ... columns, by elimination."""
    a = g.copy()
    k = len(a) - 1
    out = np.empty(k + 1)
    out[0] = a[k, k]
    for i in range(k):
        if a[i, i] > 1e-12 * max(g[i, i], 1e-300):
            a[i + 1:, i + 1:] -= np.outer(a[i + 1:, i], a[i, i + 1:]) / a[i, i]
        out[i + 1] = a[k, k]
    return out


def adf_max_lag(n: int, regression: str) -> int:
    return min(n // 2 - len(regression) - 1, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))


def _adf_row(row, regression: str, lags: int | None) -> dict:
    if row.n < MIN_ROWS:
        return {"error": "Not enough observations for stationarity tests"}
    m = Moments(row)
    if m.sxx <= 0:
        return {"error": "Series is constant"}
    p = m.lag_by_aic(regression, adf_max_lag(m.n, regression)) if lags is None else lags
    stat, _, _, _ = m.level_t(regression, p)
    if not np.isfinite(stat):
        return {"error": "Degenerate regression"}
    pv, nobs = adf_p_value(stat, regression), m.n - 1 - p
    return {"statistic": stat, "p_value": pv, "lags": p, "n_obs": nobs, "stationary": bool(pv < 0.05),
            "critical_values": adf_critical(regression, nobs)}


def adf(series: Series, regression: str = "c", lags: int | None = None,
        moments: DataFrame | None = None) -> DataFrame:
    """keys, test, statistic, p_value, lags, n_obs, stationary, critical_values, error.

    Augmented Dickey-Fuller; the lag order minimises the AIC unless ``lags`` is given.
    """
    moments = difference_moments(series) if moments is None else moments
    keys = series.keys

    def run(batches):
        for pdf in batches:
            yield _frame(pdf, keys, "adf", [_adf_row(r, regression, lags) for r in pdf.itertuples(index=False)])

    return moments.mapInPandas(run, _schema(moments, keys))


def phillips_perron(series: Series, lags: int | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Phillips-Perron test with a constant: the Dickey-Fuller t ratio corrected by a
    Bartlett-weighted long-run variance of the residuals."""
    keys = series.keys
    moments = difference_moments(series) if moments is None else moments
    fit_schema = T.StructType([*key_fields(moments, keys)] + [
        T.StructField(c, T.DoubleType()) for c in ("a", "b", "t_level", "rss", "se")])

    def fit(batches):
        for pdf in batches:
            got = []
            for r in pdf.itertuples(index=False):
                if r.n < MIN_ROWS or r.sxx <= 0:
                    got.append((np.nan,) * 5)
                    continue
                t, rss, se, beta = Moments(r).level_t("c", 0)
                got.append((beta[0], beta[1], t, rss, se))
            out = pdf[[*keys]].reset_index(drop=True)
            for i, c in enumerate(("a", "b", "t_level", "rss", "se")):
                out[c] = np.array([g[i] for g in got], float)
            yield out

    fits = write_table(moments.mapInPandas(fit, fit_schema))
    top = F.least(F.lit(lags) if lags is not None else long_lag(F.col("n")), F.col("n").cast("int") - 2)
    rows = series.attach(fits.where(~F.isnan("se"))).select(
        *keys, "block", "t", "n", "a", "b", series.demeaned().alias("x"), top.alias("max_lag"))
    halo = with_halo(series, rows, F.col("max_lag") + 1)
    before = F.lag("x").over(W.partitionBy(*keys, "block").orderBy("t"))
    halo = halo.withColumn("u", F.when(F.col("t") > 0, F.coalesce(
        F.col("x") - before - F.col("a") - F.col("b") * before, F.lit(0.0))).otherwise(0.0))
    spectra = lag_arrays(lag_products(series, halo, [("u", "u")], "max_lag"), keys, 1)
    table = series.one_row_each().join(fits, keys).join(spectra, keys, "left")

    def one(r) -> dict:
        if r.n < MIN_ROWS:
            return {"error": "Not enough observations for stationarity tests"}
        if r.p0 is None or not np.isfinite(r.t_level):
            return {"error": "Degenerate regression"}
        nobs = r.n - 1
        c = np.asarray(r.p0, float)
        weights = 1 - np.arange(1, len(c)) / len(c)
        long_run = (c[0] + 2 * float(weights @ c[1:])) / nobs
        short = r.rss / nobs
        s = np.sqrt(r.rss / (nobs - 2))
        if long_run <= 0:
            return {"error": "Long-run variance is not positive"}
        stat = float(np.sqrt(short / long_run) * r.t_level
                     - 0.5 * (long_run - short) / np.sqrt(long_run) * (nobs * r.se / s))
        pv = adf_p_value(stat, "c")
        return {"statistic": stat, "p_value": pv, "lags": len(c) - 1, "n_obs": nobs,
                "stationary": bool(pv < 0.05), "critical_values": adf_critical("c", nobs)}

    def run(batches):
        for pdf in batches:
            yield _frame(pdf, keys, "pp", [one(r) for r in pdf.itertuples(index=False)])

    return table.mapInPandas(run, _schema(table, keys))


def kpss(series: Series, regression: str = "c") -> DataFrame:
    """KPSS test around a level (``c``) or a trend (``ct``) with the long fixed lag window."""
    keys = series.keys
    resid = series.demeaned() if regression == "c" else series.detrended()
    rows = series.rows.select(*keys, "block", "t", "n", resid.alias("r")).withColumn(
        "max_lag", F.least(long_lag(F.col("n")), F.col("n").cast("int") - 1))
    paths = running_sums(series, rows, {"path": F.col("r")}).groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("path") * F.col("path")).alias("ss"))
    halo = with_halo(series, rows, F.col("max_lag"))
    spectra = lag_arrays(lag_products(series, halo, [("r", "r")], "max_lag"), keys, 1)
    table = paths.join(spectra, keys)
    size = F.size("p0")
    weighted = F.aggregate(
        F.transform(F.slice("p0", 2, F.greatest(size - 1, F.lit(1))), lambda x, i: x * (1 - (i + 1) / size)),
        F.lit(0.0), lambda s, x: s + x)
    n = F.col("n").cast("double")
    spectrum = (F.element_at("p0", 1) + 2 * weighted) / n
    few = F.when(F.col("n") < MIN_ROWS, F.lit("Not enough observations for stationarity tests"))
    table = table.withColumn("error", F.coalesce(few, F.when(
        spectrum <= 0, F.lit("Long-run variance is not positive"))))
    table = table.withColumn("statistic", F.when(F.col("error").isNull(), F.col("ss") / (n * n) / spectrum))
    crit = KPSS_CRITICAL[regression]
    p = F.when(F.col("statistic").isNull(), None).when(F.col("statistic") <= crit[0], KPSS_P[0])
    for lo, hi, plo, phi in zip(crit, crit[1:], KPSS_P, KPSS_P[1:], strict=False):
        p = p.when(F.col("statistic") <= hi, plo + (phi - plo) * (F.col("statistic") - lo) / (hi - lo))
    levels = F.create_map(*[v for name, c in zip(("10%", "5%", "2.5%", "1%"), crit, strict=True)
                            for v in (F.lit(name), F.lit(c))])
    name = "kpss_level" if regression == "c" else "kpss_trend"
    return table.withColumn("p_value", p.otherwise(KPSS_P[-1])).select(
        *keys, F.lit(name).alias("test"), "statistic", "p_value", (size - 1).alias("lags"),
        F.col("n").alias("n_obs"), (F.col("p_value") > 0.05).alias("stationary"),
        levels.alias("critical_values"), "error")


def stationarity(series: Series) -> DataFrame:
    """All four tests for every series, one row per test."""
    moments = write_table(difference_moments(series))
    out = adf(series, moments=moments)
    for part in (kpss(series, "c"), kpss(series, "ct"), phillips_perron(series, moments=moments)):
        out = out.unionByName(part)
    return out
