"""Shapiro-Wilk test (Royston 1995, algorithm AS R94) over all values of a column.

W is the square of a sum over the ordered values, each weighted by the normal quantile of its position. Positions come from
sorted runs, so tasks add up quantile times value over ranges of positions, and only sums and the outermost values meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.runs import ranked_runs
from plumbline.functions.tables import write_table
from plumbline.functions.tails import normal_cdf
from plumbline.operators.describe import long_numbers

# Royston's polynomial coefficients, ascending powers.
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]
G = [-2.273, 0.459]


def _poly(coef: list[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coef))


# Wichura's rational approximations of the normal quantile (AS 241), descending powers.
CENTRE = ([2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
           1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0],
          [5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
           5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0])
TAIL = ([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
         3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0],
        [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
         6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0])


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    out = np.empty(len(p))
    mid = np.abs(q) <= 0.425
    r = 0.180625 - q[mid] ** 2
    out[mid] = q[mid] * np.polyval(CENTRE[0], r) / np.polyval(CENTRE[1], r)
    r = np.sqrt(-np.log(np.minimum(p[~mid], 1 - p[~mid]))) - 1.6
    out[~mid] = np.sign(q[~mid]) * np.polyval(TAIL[0], r) / np.polyval(TAIL[1], r)
    # Beyond the reach of the second formula.
    for i in np.flatnonzero(np.minimum(p, 1 - p) < 1.4e-11):
        out[i] = NormalDist().inv_cdf(p[i])
    return out


def _positions(first: np.ndarray, n: float) -> np.ndarray:
    """Normal quantiles of positions (from 0) among ``n`` values."""
    return normal_quantiles((first + 0.625) / (n + 0.25))


def _ends(n: int, norm2: float, outer: np.ndarray) -> tuple[float, float, float]:
    """(weight of the last value, of the one before, scale of the others); ``outer`` has the last two quantiles.

    The weight before the last is that of the others where ``n`` is at most 5.
    """
    u, root = 1 / math.sqrt(n), math.sqrt(norm2)
    last = outer[1] / root + _poly(C1, u)
    if n <= 5:
        phi = (norm2 - 2 * outer[1] ** 2) / (1 - 2 * last**2)
        return last, outer[0] / math.sqrt(phi) if n > 3 else 0.0, math.sqrt(phi)
    before = outer[0] / root + _poly(C2, u)
    phi = (norm2 - 2 * outer[1] ** 2 - 2 * outer[0] ** 2) / (1 - 2 * last**2 - 2 * before**2)
    return last, before, math.sqrt(phi)


def w_statistic(n: int, weighted: float, norm2: float, squares: float, outer: tuple[float, float, float, float]) -> float:
    """W from sums over all positions: quantile times value, squared quantiles, squared deviations, and the outermost values."""
    if squares <= 0:
        return 1.0
    if n == 3:
        return min(((outer[3] - outer[0]) * math.sqrt(0.5)) ** 2 / squares, 1.0)
    m = _positions(np.array([n - 2.0, n - 1.0]), n)
    last, before, scale = _ends(n, norm2, m)
    spread = outer[3] - outer[0], outer[2] - outer[1]
    inner = weighted - m[1] * spread[0] - m[0] * spread[1]
    return min((inner / scale + last * spread[0] + before * spread[1]) ** 2 / squares, 1.0)


def p_value(n: int, w: float) -> tuple[float, float]:
    """(W, its p-value); the approximation is made for at most 5,000 values."""
    if n == 3:
        low = math.asin(math.sqrt(0.75))
        return max(w, 0.75), max(0.0, 6 / math.pi * (math.asin(math.sqrt(max(w, 0.75))) - low))
    if w >= 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        top = _poly(G, n)
        if y >= top:
            return w, 1e-99
        y, mu, sigma = -math.log(top - y), _poly(C3, n), math.exp(_poly(C4, n))
    else:
        mu, sigma = _poly(C5, math.log(n)), math.exp(_poly(C6, math.log(n)))
    return w, float(normal_cdf(-(y - mu) / sigma))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value of a few values at hand."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    x = x - x.mean()
    m = _positions(np.arange(n), n)
    return p_value(n, w_statistic(n, float(m @ x), float(m @ m), float(x @ x), (x[0], x[1], x[-2], x[-1])))


PIECE = 1 << 16      # positions of equal values that one row stands for at most


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row (equal values at the positions first..last): sums of quantiles and of their squares."""
    for pdf in batches:
        count = (pdf["last"] - pdf["first"] + 1).to_numpy()
        s1, s2 = np.empty(len(pdf)), np.empty(len(pdf))
        for lo in range(0, len(pdf), 64):
            own = count[lo:lo + 64]
            start = np.cumsum(own) - own
            place = np.arange(own.sum()) - np.repeat(start, own) + np.repeat(pdf["first"].to_numpy()[lo:lo + 64], own)
            m = normal_quantiles((place + 0.625) / (np.repeat(pdf["n"].to_numpy()[lo:lo + 64], own) + 0.25))
            s1[lo:lo + 64], s2[lo:lo + 64] = np.add.reduceat(m, start), np.add.reduceat(m * m, start)
        yield pd.DataFrame({"column": pdf["column"], "weighted": s1 * pdf["value"], "norm2": s2})


def _tests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            w, p = (np.nan, np.nan) if r.n < 3 else p_value(int(r.n), w_statistic(int(r.n), r.weighted, r.norm2, r.squares, (r.x0, r.x1, r.y1, r.y0)))
            rows.append((r.column, "shapiro_wilk", int(r.n), w, p, bool(p >= 0.05) if r.n >= 3 else None, bool(r.n > 5000),
                         "too few observations" if r.n < 3 else None))
        out = pd.DataFrame(rows, columns=["column", "test", "n_used", "statistic", "p_value", "is_normal", "large_sample", "error"])
        out["is_normal"] = out["is_normal"].astype("boolean")
        yield out


def shapiro(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, test, n_used, statistic, p_value, is_normal, large_sample, error over all values of every column.

    ``large_sample`` marks columns of more than 5,000 values, for which W is exact but the p-value's approximation was not made.
    """
    cells = long_numbers(df, cols)
    means = cells.groupBy("column").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("squares"))
    runs = write_table(ranked_runs(cells, ["column"], ["value"]))
    # A row per column of the input, so they are sent to the tasks.
    centred = runs.join(F.broadcast(write_table(means)), "column").withColumn("value", F.col("value") - F.col("mean"))
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE))
    pieces = centred.select("column", "value", "start", "copies", F.col("total").alias("n"), F.explode(at).alias("k"))
    first = F.col("start") + F.col("k") * PIECE
    pieces = pieces.select("column", "value", "n", first.alias("first"), F.least(first + PIECE - 1, F.col("start") + F.col("copies") - 1).alias("last"))
    sums = pieces.mapInPandas(_sums, "column string, weighted double, norm2 double").groupBy("column").agg(
        F.sum("weighted").alias("weighted"), F.sum("norm2").alias("norm2"))
    n = F.col("total")

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("start") <= place) & (place < F.col("start") + F.col("copies")), F.col("value")))

    outer = centred.groupBy("column").agg(F.max("total").alias("n"), F.max("squares").alias("squares"), *[
        value_at(place).alias(name) for name, place in (("x0", F.lit(0)), ("x1", F.lit(1)), ("y1", n - 2), ("y0", n - 1))])
    return outer.join(F.broadcast(sums), "column").mapInPandas(
        _tests, "column string, test string, n_used long, statistic double, p_value double, is_normal boolean, large_sample boolean, error string")
