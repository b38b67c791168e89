"""Upper tail probabilities of the normal, chi-squared, F and t distributions.

Vectorised numpy; series and continued fractions for the incomplete gamma and
beta functions as given in Abramowitz & Stegun (6.5.29, 6.5.31, 26.5.8). The
column functions at the end are Arrow-batched and meant for result tables (one
row per column, series or candidate), not for data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    small = ok & (x > 0) & (x < a + 1)
    if small.any():
        s, z = a[small], x[small]
        term = 1 / s
        total, k = term.copy(), s.copy()
        for _ in range(10_000):
            k += 1
            term = term * z / k
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[small] = 1 - total * np.exp(-z + s * np.log(z) - _lgamma(s))
    large = ok & (x >= a + 1)
    if large.any():
        s, z = a[large], x[large]
        b = z + 1 - s
        c = np.full(s.shape, 1 / TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[large] = h * np.exp(-z + s * np.log(z) - _lgamma(s))
    return out


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    inner = ok & (x > 0) & (x < 1)
    if not inner.any():
        return out
    a, b, x = a[inner], b[inner], x[inner]
    flip = x > (a + 1) / (a + b + 2)
    p, r, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(p + r) - _lgamma(p) - _lgamma(r) + p * np.log(z) + r * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 - (p + r) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 20_000):
        for num in (m * (r - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + r + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    val = front * h
    out[inner] = np.where(flip, 1 - val, val)
    return out


def chi2_sf(x, df):
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def f_sf(x, df1, df2):
    x, df1, df2 = (np.asarray(v, float) for v in (x, df1, df2))
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def f_tail(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(x.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


def chi2_tail_even(x: Column, df: int) -> Column:
    """Chi-squared tail for an even number of degrees of freedom, closed form in the JVM."""
    half, term = x / 2, F.lit(1.0)
    total = term
    for j in range(1, df // 2):
        term = term * half / j
        total = total + term
    return F.exp(-half) * total


def clean_p(p: Column) -> Column:
    """NaN (undefined statistic) becomes NULL."""
    return F.when(~F.isnan(p), p)
