"""Autocorrelation, partial autocorrelation, Ljung-Box and ARCH-LM, all inside the JVM
but for the tail probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.lags import key_fields, lagged
from plumbline.functions.linear import pseudo_inverse
from plumbline.functions.series import Series
from plumbline.functions.tails import chi2_sf, chi2_tail, chi2_tail_even, f_sf

MIN_ROWS = 10


def _autocovariances(series: Series, nlags: int) -> DataFrame:
    """keys, n, c: array of sums of lagged products of the demeaned values, lags 0..nlags."""
    rows = lagged(series, series.rows, series.demeaned(), nlags)
    sums = [F.sum(F.col("_v") * F.col("_v"))] + [
        F.coalesce(F.sum(F.col("_v") * F.col(f"lag{k}")), F.lit(0.0)) for k in range(1, nlags + 1)]
    return rows.groupBy(*series.keys).agg(F.max("n").alias("n"), F.array(*sums).alias("c"))


def _few() -> Column:
    return F.when(F.col("n") < MIN_ROWS, F.lit("Too few observations"))


def _partial(r: Column, top: Column) -> Column:
    """Partial autocorrelations 1..top of an autocovariance array by the Durbin-Levinson recursion."""
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.element_at(r, 1).alias("v"),
                     F.array(F.lit(1.0)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]
        back = F.reverse(F.slice(r, 2, F.greatest(k - 1, F.lit(0))))
        dot = F.aggregate(F.zip_with(phi, back, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
        ref = F.try_divide(F.element_at(r, (k + 1).cast("int")) - dot, acc["v"])
        new = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - ref * b), F.array(ref))
        return F.struct(new.alias("phi"), (acc["v"] * (1 - ref * ref)).alias("v"),
                        F.concat(acc["out"], F.array(ref)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step)["out"]


def acf(series: Series, nlags: int = 12) -> DataFrame:
    """keys, lag, acf, pacf, pacf_ywm, n, error: lags 0 .. min(nlags, n div 2).

    ``acf`` divides by n. ``pacf`` solves Yule-Walker with autocovariances over
    n - k, ``pacf_ywm`` with those over n.
    """
    table = _autocovariances(series, nlags).withColumn(
        "top", F.least(F.lit(nlags), F.floor(F.col("n") / 2)).cast("int"))
    c, n = F.col("c"), F.col("n")
    table = table.withColumn("error", F.coalesce(_few(), F.when(
        F.element_at(c, 1) <= 0, F.lit("Series is constant"))))
    fine = F.col("error").isNull()
    adjusted = F.transform(c, lambda x, k: F.try_divide(x, n - k))
    table = table.select(
        *series.keys, "n", "top", "error",
        F.when(fine, F.transform(c, lambda x: x / F.element_at(c, 1))).alias("a"),
        F.when(fine, _partial(adjusted, F.col("top"))).alias("p"),
        F.when(fine, _partial(F.transform(c, lambda x: x / n), F.col("top"))).alias("m"))
    lag = F.explode(F.when(F.col("error").isNull(), F.sequence(F.lit(0), F.col("top")))
                    .otherwise(F.array(F.lit(None).cast("int"))))
    at = lambda a: F.try_element_at(F.col(a), F.col("lag") + 1)
    return table.withColumn("lag", lag).select(
        *series.keys, "lag", at("a").alias("acf"), at("p").alias("pacf"), at("m").alias("pacf_ywm"),
        "n", "error")


def ljung_box(series: Series, lags: int = 12) -> DataFrame:
    """keys, lag, statistic, p_value, n, error."""
    table = _autocovariances(series, lags)
    n, c = F.col("n").cast("double"), F.col("c")
    terms = F.transform(F.slice(c, 2, lags), lambda x, k: F.pow(x / F.element_at(c, 1), F.lit(2)) / (n - k - 1))
    stat = n * (n + 2) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    error = F.coalesce(_few(), F.when(F.col("n") <= lags, F.lit("Too few observations for the lags")),
                       F.when(F.element_at(c, 1) <= 0, F.lit("Series is constant")))
    out = table.withColumn("error", error).withColumn("statistic", F.when(F.col("error").isNull(), stat))
    p = (chi2_tail_even(F.col("statistic"), lags) if lags % 2 == 0
         else chi2_tail(F.col("statistic"), F.lit(float(lags))))
    return out.select(*series.keys, F.lit(lags).alias("lag"), "statistic",
                      F.when(F.col("statistic").isNotNull(), p).alias("p_value"), "n", "error")


def arch_lm(series: Series, lags: int = 5) -> DataFrame:
    """keys, lags, n, lm, lm_p, f, f_p, has_arch_effects, error: squared values on their own lags."""
    keys = series.keys
    # y^2 less a constant; the regression has an intercept, so the constant drops out.
    square = series.demeaned() * (series.demeaned() + 2 * F.col("mean"))
    rows = lagged(series, series.rows, square, lags)
    names = ["_v", *[f"lag{k}" for k in range(1, lags + 1)]]
    full = F.col(f"lag{lags}").isNotNull()
    sums = [F.coalesce(F.sum(F.when(full, F.col(a))), F.lit(0.0)) for a in names]
    products = [F.coalesce(F.sum(F.when(full, F.col(a) * F.col(b))), F.lit(0.0))
                for i, a in enumerate(names) for b in names[i:]]
    table = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*sums).alias("s"),
                                    F.array(*products).alias("g"))
    need = lags * 2 + 5
    schema = T.StructType([*key_fields(table, keys)] + [
        T.StructField(c, t) for c, t in (
            ("lags", T.IntegerType()), ("n", T.LongType()), ("lm", T.DoubleType()), ("lm_p", T.DoubleType()),
            ("f", T.DoubleType()), ("f_p", T.DoubleType()), ("has_arch_effects", T.BooleanType()),
            ("error", T.StringType()))])

    def solve(row) -> tuple:
        if row.n < need:
            return (np.nan,) * 4 + (None, f"Need at least {need} observations (have {row.n})")
        m = lags + 1
        g = np.zeros((m, m))
        g[np.triu_indices(m)] = row.g
        g = g + g.T - np.diag(np.diag(g))
        nobs, s = row.n - lags, np.asarray(row.s)
        g -= np.outer(s, s) / nobs
        if g[0, 0] <= 0:
            return (np.nan,) * 4 + (None, "Squared series is constant")
        inv, rank = pseudo_inverse(g[1:, 1:])
        r2 = float(g[1:, 0] @ inv @ g[1:, 0] / g[0, 0])
        rest = nobs - rank - 1
        lm, f = nobs * r2, (r2 / rank) / ((1 - r2) / rest)
        lm_p = float(chi2_sf(lm, lags))
        return lm, lm_p, f, float(f_sf(f, rank, rest)), lm_p < 0.05, None

    def solve_batch(batches):
        for pdf in batches:
            got = [solve(r) for r in pdf.itertuples(index=False)]
            out = pdf[[*keys]].copy()
            out["lags"], out["n"] = np.int32(lags), pdf["n"]
            for i, c in enumerate(("lm", "lm_p", "f", "f_p")):
                out[c] = np.array([g[i] for g in got], float)
            out["has_arch_effects"] = pd.array([g[4] for g in got], dtype="boolean")
            out["error"] = [g[5] for g in got]
            yield out

    return table.mapInPandas(solve_batch, schema)
