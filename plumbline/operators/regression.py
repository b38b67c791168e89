"""Regression diagnostics over complete rows: VIF, condition number, OLS, Breusch-Pagan, White.

The data is read by aggregates and by one cross-product pass; what reaches the
driver is a k x k matrix, k being the number of columns.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import q
from plumbline.functions.linear import gramian, pseudo_inverse, r_factor
from plumbline.functions.tails import chi2_sf, f_sf, t_two_sided
from plumbline.operators.describe import complete_cases


def _center(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, float], dict[str, float]]:
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return (one["n"], {c: one[f"m{i}"] for i, c in enumerate(cols)},
            {c: one[f"s{i}"] for i, c in enumerate(cols)})


def _centered(df: DataFrame, means: dict[str, float]) -> DataFrame:
    return df.select(*[(q(c) - F.lit(m)).alias(c) for c, m in means.items()])


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, vif: diagonal of the inverse correlation matrix; constant columns are left out."""
    spark = df.sparkSession
    schema = "column string, vif double, error string"
    rows = complete_cases(df, cols)
    n, means, spread = _center(rows, cols)
    used = [c for c in cols if n and spread[c] and spread[c] > 0]
    if not used:
        return spark.createDataFrame([], schema)
    g = gramian(_centered(rows, {c: means[c] for c in used}), used)
    d = np.sqrt(np.diag(g))
    corr = g / np.outer(d, d)
    inv, rank = pseudo_inverse(corr)
    out = []
    for i, c in enumerate(used):
        if rank == len(used):
            value = float(inv[i, i])
        else:
            # R2 of the column on the others; exactly explained means an infinite factor.
            others = [j for j in range(len(used)) if j != i]
            part, _ = pseudo_inverse(corr[np.ix_(others, others)])
            rest = 1.0 - float(corr[i, others] @ part @ corr[others, i])
            value = 1.0 / rest if rest > 1e-11 else None
        out.append((c, value, None if value is not None else "perfectly collinear"))
    return spark.createDataFrame(out, schema)


def condition_number(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: largest over smallest singular value of the columns with a constant."""
    rows = complete_cases(df, cols).withColumn("_const", F.lit(1.0))
    s = np.linalg.svd(r_factor(rows, ["_const", *cols]), compute_uv=False)
    value = float(s[0] / max(s[-1], 1e-12)) if len(s) else None
    return df.sparkSession.createDataFrame([(len(cols), value)], "n_columns int, condition_number double")


class _Fit:
    """OLS with a constant, from centred cross products."""

    def __init__(self, df: DataFrame, y: str, xs: list[str]):
        self.y, self.xs = y, xs
        self.rows = complete_cases(df, list(dict.fromkeys([y, *xs])))
        self.n, self.means, _ = _center(self.rows, [y, *xs])
        k = len(xs)
        self.error = None
        if self.n <= k + 1:
            self.error = f"Need more than {k + 1} complete rows (have {self.n})"
            return
        g = gramian(_centered(self.rows, self.means), [y, *xs])
        self.inv, self.rank = pseudo_inverse(g[1:, 1:])
        self.beta = self.inv @ g[1:, 0]
        self.tss = float(g[0, 0])
        self.rss = max(self.tss - float(self.beta @ g[1:, 0]), 0.0)
        self.const = self.means[y] - sum(b * self.means[x] for b, x in zip(self.beta, xs, strict=True))

    def residual(self):
        e = q(self.y) - F.lit(self.means[self.y])
        for b, x in zip(self.beta, self.xs, strict=True):
            e = e - F.lit(float(b)) * (q(x) - F.lit(self.means[x]))
        return e


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, std_err, t, p_value, r_squared, n_used."""
    fit = _Fit(df, y, xs)
    schema = ("term string, coef double, std_err double, t double, p_value double, "
              "r_squared double, n_used long, error string")
    if fit.error:
        return df.sparkSession.createDataFrame([(None,) * 6 + (fit.n, fit.error)], schema)
    dof = fit.n - fit.rank - 1
    sigma2 = fit.rss / dof if dof > 0 else float("nan")
    mean = np.array([fit.means[x] for x in xs])
    variances = [sigma2 * (1 / fit.n + float(mean @ fit.inv @ mean)), *(sigma2 * np.diag(fit.inv))]
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else None
    out = []
    for name, b, v in zip(["const", *xs], [fit.const, *fit.beta], variances, strict=True):
        se = math.sqrt(v) if v > 0 else float("nan")
        t = float(b) / se if se > 0 else float("nan")
        p = float(t_two_sided(t, dof))
        out.append((name, float(b), *[None if math.isnan(z) else z for z in (se, t, p)], r2, fit.n, None))
    return df.sparkSession.createDataFrame(out, schema)


def _auxiliary(rows: DataFrame, cols: list[str]) -> tuple[float, int, int]:
    """R2, rank and n of the regression of column ``_e2`` on the columns with a constant."""
    n, means, spread = _center(rows, ["_e2", *cols])
    scaled = rows.select(*[((q(c) - F.lit(means[c])) / F.lit(spread[c] or 1.0)).alias(c)
                           for c in ["_e2", *cols]])
    g = gramian(scaled, ["_e2", *cols])
    inv, rank = pseudo_inverse(g[1:, 1:])
    r2 = float(g[1:, 0] @ inv @ g[1:, 0]) / g[0, 0] if g[0, 0] > 0 else float("nan")
    return r2, rank, n


def heteroskedasticity(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """test, lm, lm_p, f, f_p, df, n_used: Breusch-Pagan (Koenker form) and White."""
    schema = ("test string, lm double, lm_p double, f double, f_p double, df int, n_used long, "
              "error string")
    fit = _Fit(df, y, xs)
    if fit.error:
        return df.sparkSession.createDataFrame(
            [(t, None, None, None, None, None, fit.n, fit.error) for t in ("breusch_pagan", "white")], schema)
    base = fit.rows.select(*[q(x) for x in xs], F.pow(fit.residual(), F.lit(2)).alias("_e2"))
    # Products of centred columns span the same space as products of the columns.
    z = [q(x) - F.lit(fit.means[x]) for x in xs]
    squares = [(z[i] * z[j]).alias(f"_p{i}_{j}")
               for i, j in itertools.combinations_with_replacement(range(len(xs)), 2)]
    wide = base.select("_e2", *[a.alias(x) for a, x in zip(z, xs, strict=True)], *squares)
    names = [c for c in wide.columns if c != "_e2"]
    out = []
    for test, cols in (("breusch_pagan", xs), ("white", names)):
        r2, rank, n = _auxiliary(wide.select("_e2", *cols), cols)
        rest = n - rank - 1
        if not np.isfinite(r2) or rest <= 0:
            out.append((test, None, None, None, None, rank, n, "Degenerate auxiliary regression"))
            continue
        lm, f = float(n * r2), float((r2 / rank) / ((1 - r2) / rest))
        out.append((test, lm, float(chi2_sf(lm, rank)), f, float(f_sf(f, rank, rest)), rank, n, None))
    return df.sparkSession.createDataFrame(out, schema)
