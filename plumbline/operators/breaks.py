"""Structural breaks: Chow scan, CUSUM, Zivot-Andrews, Bai-Perron and shift in means.

Candidate scans cut a series into the segments between candidates and sum each
segment, which is one map-side combined aggregate; sums before and after every
candidate then follow from at most a few dozen rows per series. Nothing is
thinned; only Bai-Perron searches a whole series in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.critical import za_critical, za_p_value
from plumbline.functions.lags import key_fields
from plumbline.functions.series import Series, running_sums, with_halo
from plumbline.functions.tables import attach, write_table
from plumbline.functions.tails import clean_p, t_tail
from plumbline.operators.stationarity import Moments, _scaled_inverse, adf_max_lag, difference_moments

MIN_ROWS = 30
TOO_SHORT = f"fewer than {MIN_ROWS} observations"
CUSUM_BOUNDARY = 0.948


def _enough(n: Column | str = "n") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n < MIN_ROWS, F.lit(TOO_SHORT))


def _margin(n: Column, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor(n * F.lit(0.1))).cast("bigint")


def _spaced(i: Column, n: Column, margin: Column, count: int) -> Column:
    """i-th of ``count`` evenly spaced positions from margin to n - margin, cut to whole numbers."""
    step = (n - 2 * margin) / F.lit(float(count - 1))
    return F.when(i == count - 1, n - margin).otherwise(F.floor(i * step + margin)).cast("bigint")


def _before_sums(series: Series, least: int, count: int, terms: dict[str, Column]) -> DataFrame:
    """keys, n, candidate, split, and per term the sum before the split (``_a``) and from it on (``_b``)."""
    keys = series.keys
    margin = _margin(F.col("n"), least)
    # A row belongs to the segment after the last candidate at or below t.
    rows = series.rows.where(F.col("n") >= MIN_ROWS).withColumn("_margin", margin)
    step = (F.col("n") - 2 * F.col("_margin")) / F.lit(float(count - 1))
    guess = F.ceil((F.col("t") + 1 - F.col("_margin")) / step) - 1
    # Rounding may put the guess one off; the two neighbours decide.
    at = lambda i: _spaced(i, F.col("n"), F.col("_margin"), count)
    rows = rows.withColumn("_g", F.greatest(F.least(guess, F.lit(count - 1)), F.lit(-1)).cast("bigint"))
    rows = rows.withColumn("_g", F.when((F.col("_g") < count - 1) & (at(F.col("_g") + 1) <= F.col("t")),
                                        F.col("_g") + 1).when(
        (F.col("_g") >= 0) & (at(F.col("_g")) > F.col("t")), F.col("_g") - 1).otherwise(F.col("_g")))
    parts = rows.select(*keys, "n", (F.col("_g") + 1).alias("candidate"),
                        *[e.alias(k) for k, e in terms.items()])
    # One empty row per candidate keeps coinciding candidates in the result.
    heads = series.rows.where((F.col("t") == 0) & (F.col("n") >= MIN_ROWS)).select(
        *keys, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count).cast("bigint"))).alias("candidate"),
        *[F.lit(0.0).alias(k) for k in terms])
    sums = parts.unionByName(heads).groupBy(*keys, "candidate").agg(
        F.max("n").alias("n"), *[F.sum(k).alias(k) for k in terms])
    by = W.partitionBy(*keys)
    upto = by.orderBy("candidate").rowsBetween(W.unboundedPreceding, 0)
    out = sums.select(*keys, "n", "candidate",
                      *[F.sum(k).over(upto).alias(f"{k}_a") for k in terms],
                      *[F.sum(k).over(by).alias(f"{k}_t") for k in terms])
    out = out.where(F.col("candidate") < count).withColumn("_margin", margin).withColumn(
        "split", at(F.col("candidate")))
    return out.select(*keys, "n", "candidate", "split", *[F.col(f"{k}_a") for k in terms],
                      *[(F.col(f"{k}_t") - F.col(f"{k}_a")).alias(f"{k}_b") for k in terms])


def _break_dates(series: Series, found: DataFrame, index: str = "break_index") -> DataFrame:
    """Add ``break_ts``, the date at the break index."""
    keys = series.keys
    wanted = found.where(F.col(index).isNotNull()).select(
        *keys, F.col(index).alias("t")).distinct().withColumn("block", F.floor(F.col("t") / series.block_rows))
    dates = series.rows.select(*keys, "block", "t", "ts").join(wanted, [*keys, "block", "t"]).select(
        *keys, F.col("t").alias(index), F.col("ts").alias("break_ts"))
    return found.join(dates, [*keys, index], "left")


def _line_rss(n: Column, first: Column, s: str) -> Column:
    """Residual sum of a line fit from sums of r, r^2 and r*t over n rows from position ``first`` on."""
    mid = first + (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    sxy = F.col(f"rt_{s}") - mid * F.col(f"r_{s}")
    return F.greatest(F.col(f"rr_{s}") - F.try_divide(F.pow(F.col(f"r_{s}"), F.lit(2)), n)
                      - F.try_divide(sxy * sxy, sxx), F.lit(0.0))


def chow_scan(series: Series, n_candidates: int = 20) -> DataFrame:
    """keys, candidate, break_index, f, p_value, significant, n, error: all candidate splits.

    Lines before and after the split against one line. With two parameters per
    line the tail of F(2, d) has a closed form.
    """
    keys = series.keys
    r = series.detrended()
    # Residuals of the common line: the fits before and after lose the same line, so only
    # small numbers are squared. Time is measured from the middle.
    mid = (F.col("n") - 1) / 2.0
    sums = _before_sums(series, 10, n_candidates,
                        {"r": r, "rr": r * r, "rt": r * (F.col("t") - mid)})
    n, split = F.col("n").cast("double"), F.col("split").cast("double")
    full = F.col("rr_a") + F.col("rr_b")
    rss = _line_rss(split, -mid, "a") + _line_rss(n - split, split - mid, "b")
    dof = n - 4
    f = F.try_divide((full - F.col("rss")) / 2 * dof, F.col("rss"))
    small = F.when(F.col("split") <= 2, F.lit("Sub-sample 1 too small for Chow test")).when(
        F.col("n") - F.col("split") <= 2, F.lit("Sub-sample 2 too small for Chow test"))
    out = sums.withColumn("rss", rss).withColumn("error", F.coalesce(small, F.when(
        (F.col("rss") <= full * 1e-24) | (dof <= 0), F.lit("Degenerate regression"))))
    out = out.withColumn("f", F.when(F.col("error").isNull(), f))
    return out.withColumn("p_value", F.pow(1 + 2 * F.col("f") / dof, -dof / 2)).select(
        *keys, "candidate", F.col("split").alias("break_index"), "f", "p_value",
        (F.col("p_value") < 0.05).alias("significant"), "n", "error")


def chow_at(series: Series, split: int) -> DataFrame:
    """keys, break_index, f, p_value, significant, n, error: one split given by position."""
    keys = series.keys
    r, mid = series.detrended(), (F.col("n") - 1) / 2.0
    a = F.col("t") < split
    terms = {"r": r, "rr": r * r, "rt": r * (F.col("t") - mid)}
    sums = series.rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.coalesce(F.sum(F.when(a, e)), F.lit(0.0)).alias(f"{k}_a") for k, e in terms.items()],
        *[F.coalesce(F.sum(F.when(~a, e)), F.lit(0.0)).alias(f"{k}_b") for k, e in terms.items()])
    n, at = F.col("n").cast("double"), F.lit(float(split))
    full = F.col("rr_a") + F.col("rr_b")
    small = F.when(F.lit(split <= 2), F.lit("Sub-sample 1 too small for Chow test")).when(
        F.col("n") - split <= 2, F.lit("Sub-sample 2 too small for Chow test"))
    out = sums.withColumn("rss", _line_rss(at, -mid, "a") + _line_rss(n - at, at - mid, "b")).withColumn(
        "error", F.coalesce(small, F.when(F.col("rss") <= full * 1e-24, F.lit("Degenerate regression"))))
    f = F.try_divide((full - F.col("rss")) / 2 * (n - 4), F.col("rss"))
    return out.withColumn("f", F.when(F.col("error").isNull(), f)).withColumn(
        "p_value", F.pow(1 + 2 * F.try_divide(F.col("f"), n - 4), -(n - 4) / 2)).select(
        *keys, F.lit(split).cast("bigint").alias("break_index"), "f", "p_value",
        (F.col("p_value") < 0.05).alias("significant"), "n", "error")


def _with_short(series: Series, found: DataFrame) -> DataFrame:
    """Add a row with the reason for every series that is too short to be tested."""
    short = series.one_row_each().where(F.col("n") < MIN_ROWS).withColumn("error", _enough())
    return found.unionByName(short, allowMissingColumns=True)


def _best(scan: DataFrame, keys: list[str], score: Column, cols: list[str]) -> DataFrame:
    """The row with the largest score per series, the first candidate on ties."""
    top = scan.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.when(score.isNotNull(), F.struct(score, -F.col("candidate")))).alias("_b"),
        F.max("n").alias("n"), F.min("error").alias("_e"))
    return top.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols], "n",
                      F.when(F.col("_b").isNull(), F.col("_e")).alias("error"))


def chow(series: Series, n_candidates: int = 20, scan: DataFrame | None = None) -> DataFrame:
    """The split with the largest F statistic per series."""
    scan = chow_scan(series, n_candidates) if scan is None else scan
    best = _with_short(series, _best(scan, series.keys, F.col("f"), ["break_index", "f", "p_value", "significant"]))
    return _break_dates(series, best)


def mean_shift_scan(series: Series, n_candidates: int = 50) -> DataFrame:
    """keys, candidate, break_index, t, df, mean_before, mean_after, n, error (distinct splits)."""
    keys = series.keys
    y = series.demeaned()
    sums = _before_sums(series, 5, n_candidates, {"y": y, "yy": y * y})
    first = F.row_number().over(W.partitionBy(*keys, "split").orderBy("candidate"))
    sums = sums.withColumn("_k", first).where("_k = 1")
    n1 = F.col("split").cast("double")
    n2 = (F.col("n") - F.col("split")).cast("double")
    m1, m2 = F.col("y_a") / n1, F.col("y_b") / n2
    v1 = F.greatest(F.col("yy_a") - n1 * m1 * m1, F.lit(0.0)) / (n1 - 1) / n1
    v2 = F.greatest(F.col("yy_b") - n2 * m2 * m2, F.lit(0.0)) / (n2 - 1) / n2
    means = series.rows.where("t = 0").select(*keys, "mean")
    out = sums.select(*keys, "candidate", F.col("split").alias("break_index"), "n", m1.alias("m1"),
                      m2.alias("m2"), v1.alias("v1"), v2.alias("v2"), n1.alias("n1"), n2.alias("n2"))
    v = F.col("v1") + F.col("v2")
    ok = (F.col("n1") >= 3) & (F.col("n2") >= 3) & (v > 0) & (F.col("n") >= MIN_ROWS)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(v))
    df = F.try_divide(v * v, F.col("v1") * F.col("v1") / (F.col("n1") - 1) + F.col("v2") * F.col("v2") / (F.col("n2") - 1))
    return out.join(means, keys).select(
        *keys, "candidate", "break_index", F.when(ok, t).alias("t"), F.when(ok, df).alias("df"),
        (F.col("m1") + F.col("mean")).alias("mean_before"), (F.col("m2") + F.col("mean")).alias("mean_after"),
        "n", F.when(~ok, F.lit("Could not compute shift-in-means test")).alias("error"))


def mean_shift(series: Series, n_candidates: int = 50) -> DataFrame:
    """The split with the largest absolute Welch t per series, with its p-value."""
    scan = mean_shift_scan(series, n_candidates)
    best = _with_short(series, _best(scan, series.keys, F.abs("t"), [
        "break_index", "t", "df", "mean_before", "mean_after"]))
    best = best.withColumn("shift_magnitude", F.col("mean_after") - F.col("mean_before"))
    best = best.withColumn("p_value", clean_p(t_tail(F.col("t"), F.col("df"))))
    return _break_dates(series, best.withColumn("significant", F.col("p_value") < 0.05))


def cusum_path(series: Series) -> DataFrame:
    """keys, t, residual, cusum: standardised running sum of one-step-ahead residuals.

    Each residual compares y(t) with the line through all earlier points, whose
    coefficients follow from running sums; linear in the length of the series.
    """
    keys = series.keys
    mid = (F.col("n") - 1) / 2.0
    r = series.detrended()
    rows = series.rows.select(*keys, "block", "t", "n", r.alias("r"), (r * (F.col("t") - mid)).alias("rt"))
    sums = running_sums(series, rows, {"s": F.col("r"), "st": F.col("rt")})
    i = F.col("t").cast("double")                       # points before t
    s, st = F.col("s") - F.col("r"), F.col("st") - F.col("rt")
    center = (i - 1) / 2.0 - mid
    slope = (st - center * s) / (i * (i * i - 1) / 12.0)
    ahead = (F.col("t") - mid) - center
    steps = sums.where("t >= 3").select(
        *keys, "block", "t", "n", (F.col("r") - (s / i + slope * ahead)).alias("residual"))
    steps = running_sums(series, write_table(steps), {"total": F.col("residual")})
    spread = steps.groupBy(*keys).agg(F.stddev_samp("residual").alias("sigma"), F.count("t").alias("m"))
    spread = spread.withColumn("sigma", F.when(F.coalesce("sigma", F.lit(1.0)) == 0, 1.0).otherwise(
        F.coalesce("sigma", F.lit(1.0))))
    steps = attach(steps, spread, keys, "block")
    return steps.select(*keys, "t", "n", "residual",
                        (F.col("total") / F.col("sigma") / F.sqrt("m")).alias("cusum"))


def cusum(series: Series) -> DataFrame:
    """keys, max_cusum, break_index, break_ts, boundary_5pct, rejects_stability, n, error."""
    keys = series.keys
    path = cusum_path(series)
    size = F.abs("cusum")
    top = path.groupBy(*keys).agg(
        F.max(size).alias("max_cusum"), F.max_by("t", F.struct(size, -F.col("t"))).alias("break_index"),
        F.count("t").alias("n_recursive_residuals"))
    out = series.one_row_each().join(top, keys, "left").withColumn("error", _enough())
    fine = F.col("error").isNull()
    out = out.select(*keys, F.when(fine, F.col("max_cusum")).alias("max_cusum"),
                     F.when(fine, F.col("break_index")).alias("break_index"),
                     F.lit(CUSUM_BOUNDARY).alias("boundary_5pct"),
                     F.when(fine, F.col("max_cusum") > CUSUM_BOUNDARY).alias("rejects_stability"),
                     "n_recursive_residuals", "n", "error")
    return _break_dates(series, out)


# ---------------------------------------------------------------- Zivot-Andrews

def zivot_andrews(series: Series, model: str = "c", trim: float = 0.15) -> DataFrame:
    """keys, statistic, p_value, break_index, break_ts, lags, stationary_with_break, critical_values, error.

    Smallest Dickey-Fuller t ratio over all break dates. Only the break dummies
    (level for ``c``, slope for ``t``, both for ``ct``) change from candidate to
    candidate; their products with the other regressors are sums over the rest
    of the series, which running sums and a few lagged values give, so every
    block scores its own candidates at once.
    """
    keys = series.keys
    moments = difference_moments(series)
    base_schema = T.StructType([*key_fields(moments, keys)] + [
        T.StructField("p", T.IntegerType()), T.StructField("inv", T.ArrayType(T.DoubleType())),
        T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("yy", T.DoubleType()),
        T.StructField("last", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def prepare(batches):
        for pdf in batches:
            got = []
            for row in pdf.itertuples(index=False):
                if row.n < MIN_ROWS or row.sxx <= 0:
                    got.append((0, None, None, np.nan, None,
                                f"Need at least {MIN_ROWS} observations for structural break tests"
                                if row.n < MIN_ROWS else "Series is constant"))
                    continue
                m = Moments(row)
                p = m.lag_by_aic("ct", adf_max_lag(m.n, "ct"))
                if int(m.n * trim) < p + 1:
                    got.append((p, None, None, np.nan, None, "Trimmed range is shorter than the lags"))
                    continue
                g = m.gramian(p)
                cols = [0, 1, 2, *range(4, p + 4)]
                inv = _scaled_inverse(g[np.ix_(cols, cols)])
                got.append((p, inv.ravel().tolist(), g[cols, 3].tolist(), float(g[3, 3]),
                            [float(m.level(m.n - 1 - j)) for j in range(p + 1)], None))
            out = pdf[[*keys]].reset_index(drop=True)
            for i, f in enumerate(base_schema.fields[len(keys):]):
                out[f.name] = [g[i] for g in got]
            yield out

    base = write_table(moments.mapInPandas(prepare, base_schema))
    fine = base.where("error IS NULL")
    rows = series.rows.select(*keys, "block", "t", "n", series.demeaned().alias("x"))
    rows = write_table(running_sums(series, rows, {"px": F.col("x"), "ptx": F.col("x") * (
        (F.col("t") - (F.col("n") - 1) / 2.0) / F.col("n"))}))
    lag = fine.select(*keys, "p")
    rows = attach(rows, lag, keys, "block")
    halo = with_halo(series, rows, F.col("p") + 1).drop("p")
    blocks = rows.select(*keys, "block").distinct().join(
        fine.select(*keys, "p", "inv", "b", "yy", "last"), keys)
    right = [f"_{k}" for k in [*keys, "block"]]
    blocks = blocks.select(*[F.col(k).alias(r) for k, r in zip([*keys, "block"], right, strict=True)],
                           "p", "inv", "b", "yy", "last")
    score_schema = T.StructType([*key_fields(halo, keys), T.StructField("stat", T.DoubleType()),
                                 T.StructField("at", T.LongType())])

    def score(key: tuple, pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=False)}, "stat": [np.nan], "at": [-1]})
        if not len(base) or not len(pdf):
            return none
        f = base.iloc[0]
        p, b, yy, last = int(f["p"]), np.asarray(f["b"], float), float(f["yy"]), np.asarray(f["last"], float)
        q = len(b)
        inv = np.asarray(f["inv"], float).reshape(q, q)
        pdf = pdf.sort_values("t")
        t, x, px = pdf["t"].to_numpy(), pdf["x"].to_numpy(float), pdf["px"].to_numpy(float)
        n = int(pdf["n"].iloc[0])
        cut = int(n * trim)
        pick = np.flatnonzero(pdf["core"].to_numpy() & (t >= cut + 1) & (t <= n - cut))
        if not len(pick):
            return none
        bp = t[pick].astype(float)
        mid, count = (n - 1) / 2.0, n - bp
        tau_sum = ((bp + n - 1) / 2.0 - mid) / n * count
        # Sums over t = bp .. n-1 of [1, time, level before, p earlier differences] and of y.
        level_sum = -last[0] - (px[pick] - x[pick] - x[pick - 1])
        diffs = np.column_stack([last[j] - x[pick - 1 - j] for j in range(p + 1)])
        dummies = []
        if model in ("c", "ct"):
            v = np.column_stack([count, tau_sum, level_sum, diffs[:, 1:]])
            dummies.append((v, diffs[:, 0]))
        if model in ("t", "ct"):
            # Slope dummy t - bp + 1 from bp on: weights grow by one per step.
            ptx = pdf["ptx"].to_numpy(float)
            sum_t2 = (n - bp) * (n - bp + 1) / 2.0
            tt = ((n - bp) * (n - bp + 1) * (2 * (n - bp) + 1) / 6.0 + (bp - 1 - mid) * sum_t2) / n
            # Sum of (s + 2 - bp) x(s) over s = bp-1 .. n-2, from running sums of x and of time * x.
            tot_ptx = float(f_total_ptx(pdf))
            tail_x = level_sum
            tail_tx = (tot_ptx - (n - 1 - mid) / n * last[0]
                       - (ptx[pick] - (t[pick] - mid) / n * x[pick] - (t[pick] - 1 - mid) / n * x[pick - 1]))
            lev = n * tail_tx + (mid + 2 - bp) * tail_x
            d = np.column_stack([(n - bp) * last[j] - _window_sum(n, bp, x, px, t, pick, last, j)
                                 for j in range(p + 1)])
            dummies.append((np.column_stack([sum_t2, tt, lev, d[:, 1:]]), d[:, 0]))
        r = len(dummies)
        v = np.stack([d[0] for d in dummies], axis=2)                 # candidates x q x r
        w = np.stack([d[1] for d in dummies], axis=1)                 # candidates x r
        s = np.empty((len(bp), r, r))
        if model == "c":
            s[:, 0, 0] = count
        elif model == "t":
            s[:, 0, 0] = count * (count + 1) * (2 * count + 1) / 6.0
        else:
            s[:, 0, 0] = count
            s[:, 0, 1] = s[:, 1, 0] = count * (count + 1) / 2.0
            s[:, 1, 1] = count * (count + 1) * (2 * count + 1) / 6.0
        u = np.einsum("ij,cjr->cir", inv, v)
        schur = np.linalg.pinv(s - np.einsum("cir,cis->crs", v, u), hermitian=True)
        beta0 = inv @ b
        gap = w - np.einsum("cir,i->cr", v, beta0)
        theta = np.einsum("crs,cs->cr", schur, gap)
        alpha = beta0[2] - np.einsum("cr,cr->c", u[:, 2, :], theta)
        rss = yy - b @ beta0 - np.einsum("cr,cr->c", gap, theta)
        var = inv[2, 2] + np.einsum("cr,crs,cs->c", u[:, 2, :], schur, u[:, 2, :])
        dof = n - 1 - p - q - r
        stat = alpha / np.sqrt(np.maximum(rss, 1e-300) / dof * var)
        best = int(np.argmin(stat))
        out = {k: [v] for k, v in zip(keys, key, strict=False)}
        out["stat"], out["at"] = [float(stat[best])], [int(t[pick][best])]
        return pd.DataFrame(out)

    def f_total_ptx(pdf):
        return pdf["_total_ptx"].iloc[0]

    def _window_sum(n, bp, x, px, t, pick, last, j):
        """Sum over t = bp .. n-1 of x(t - 1 - j): what the slope dummy leaves of a difference."""
        tail = -sum(last[i] for i in range(j + 1))
        head = px[pick] - sum(x[pick - i] for i in range(j + 2))
        return tail - head

    whole = rows.groupBy(*keys).agg(F.max_by("ptx", "t").alias("_total_ptx"))
    halo = attach(halo, whole, keys, "block")
    scored = halo.groupBy(*keys, "block").cogroup(blocks.groupBy(*right)).applyInPandas(
        score, score_schema)
    best = scored.where("at >= 0").groupBy(*keys).agg(F.min(F.struct("stat", "at")).alias("m"))
    p_value = F.pandas_udf(lambda s: s.map(lambda v: za_p_value(v, model)), "double")
    out = base.select(*keys, "p", F.col("error").alias("_e")).join(best, keys, "left").select(
        *keys, F.col("m.stat").alias("statistic"), (F.col("m.at") - 1).alias("break_index"),
        F.when(F.col("m").isNotNull(), F.col("p")).alias("lags"),
        F.coalesce("_e", F.when(F.col("m").isNull(), F.lit("No candidate break dates"))).alias("error"))
    crit = F.create_map(*[v for k, c in za_critical(model).items() for v in (F.lit(k), F.lit(c))])
    out = out.withColumn("p_value", clean_p(p_value("statistic")))
    out = out.withColumn("stationary_with_break", F.col("p_value") < 0.05).withColumn("critical_values", crit)
    return _break_dates(series, out)


# ---------------------------------------------------------------- Bai-Perron

ENDS, STARTS = 512, 8192   # a matrix of so many segment ends and starts is scored at once


def explained_by_breaks(y: np.ndarray, most: int, shortest: int) -> list[tuple[float, list[int]]]:
    """For 0, 1, .. ``most`` breaks: (residual sum of squares, positions where a new segment begins).

    With values centred, a segment of sum S and length m explains S^2 / m. The best total over k + 1 segments that end
    at j is the maximum over starts c of (best over k segments that end at c) + (P[j] - P[c])^2 / (j - c), with P the
    running sum; equal totals go to the earliest start. All points count: work is quadratic in them, memory linear.
    """
    total = np.concatenate([[0.0], np.cumsum(y - y.mean())])
    size = len(y)
    place = np.arange(size + 1)
    reached = np.where(place >= shortest, total ** 2 / np.maximum(place, 1), -np.inf)
    origin: list[np.ndarray] = []
    out = [(float(((y - y.mean()) ** 2).sum() - reached[size]), [])]
    for k in range(1, most + 1):
        value, start = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
        for lo in range((k + 1) * shortest, size + 1, ENDS):
            ends = place[lo:lo + ENDS]
            for first in range(k * shortest, int(ends[-1]) - shortest + 1, STARTS):
                begin = place[first:min(first + STARTS, int(ends[-1]) - shortest + 1)]
                length = ends[:, None] - begin[None, :]
                gain = np.where(length >= shortest, reached[begin] + (total[ends][:, None] - total[begin]) ** 2 / np.maximum(length, 1), -np.inf)
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(ends)), at]
                better = top > value[ends]
                value[ends[better]], start[ends[better]] = top[better], begin[at[better]]
        reached = value
        origin.append(start)
        path, at = [], size
        for level in reversed(origin):
            at = int(level[at])
            path.insert(0, at)
        out.append((float(((y - y.mean()) ** 2).sum() - reached[size]), path))
    return out


def bai_perron_table(series: Series, max_breaks: int = 5, min_segment: float = 0.10) -> DataFrame:
    """keys, n_breaks, break_indices, bic, selected, rss, error: one row per number of breaks.

    Exact over every point of a series. A series is searched in one task, so this is for many series of up to some
    100,000 points rather than for one without end: the time grows with the square of the length.
    """
    keys = series.keys
    schema = T.StructType([*key_fields(series.rows, keys)] + [T.StructField(c, t) for c, t in (
        ("n_breaks", T.IntegerType()), ("break_indices", T.ArrayType(T.LongType())), ("bic", T.DoubleType()),
        ("selected", T.BooleanType()), ("rss", T.DoubleType()), ("error", T.StringType()))])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["y"].to_numpy(float)
        n, named = len(y), dict(zip(keys, key, strict=False))
        # 30 points at least, segments of a tenth and never under 3, room for 3 segments of 5 or more.
        room, shortest = max(5, int(n * min_segment)), max(3, int(n * min_segment))
        problem, found = None, []
        if n < MIN_ROWS:
            problem = TOO_SHORT
        elif n < 3 * room:
            problem = f"{n} observations leave no room for several segments of {room}"
        else:
            most = max(1, min(max_breaks, n // room - 1, n // shortest - 1))
            found = [(k, path, float(n * np.log(rss / n) + k * np.log(n)), rss)
                     for k, (rss, path) in enumerate(explained_by_breaks(y, most, shortest)) if np.isfinite(rss) and rss > 0]
            if not found:
                problem = "no information criterion: nothing is left to explain"
        chosen = min(found, key=lambda r: (r[2], r[0]))[0] if found else None
        rows = [{**named, "n_breaks": k, "break_indices": path, "bic": bic, "selected": k == chosen, "rss": rss, "error": None}
                for k, path, bic, rss in found] or [{**named, "n_breaks": None, "break_indices": None, "bic": np.nan,
                                                     "selected": None, "rss": np.nan, "error": problem}]
        out = pd.DataFrame(rows)
        out["n_breaks"] = out["n_breaks"].astype("Int32")
        out["selected"] = out["selected"].astype("boolean")
        return out

    return series.rows.select(*keys, "t", "y").groupBy(*keys).applyInPandas(search, schema)


def bai_perron_segments(series: Series, table: DataFrame) -> DataFrame:
    """keys, segment, start_index, end_index, start_ts, end_ts, n_obs, mean, std over the full series."""
    keys = series.keys
    chosen = write_table(table.where("selected").select(*keys, "break_indices"))
    rows = attach(series.rows, chosen, keys, "block")
    number = F.size(F.filter("break_indices", lambda b: b <= F.col("t")))
    return rows.withColumn("segment", number).groupBy(*keys, "segment").agg(
        F.min("t").alias("start_index"), F.max("t").alias("end_index"), F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_obs"), F.avg("y").alias("mean"),
        F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"))


def bai_perron_breaks(series: Series, table: DataFrame) -> DataFrame:
    """keys, break_no, break_index, break_ts of the chosen number of breaks."""
    breaks = table.where("selected").select(
        *series.keys, F.posexplode("break_indices").alias("break_no", "break_index"))
    return _break_dates(series, breaks)


# ---------------------------------------------------------------- bundle

def break_tests(series: Series) -> DataFrame:
    """keys, test, break_index, break_ts, statistic, p_value, significant, error: one row per test."""
    keys = series.keys
    null = F.lit(None).cast("double")

    def shape(df: DataFrame, test: str, stat: str, p: Column, hit: Column) -> DataFrame:
        return df.select(*keys, F.lit(test).alias("test"), "break_index", "break_ts",
                         F.col(stat).cast("double").alias("statistic"), p.alias("p_value"),
                         hit.alias("significant"), "error")

    table = write_table(bai_perron_table(series))
    chosen = table.where("selected OR error IS NOT NULL").withColumn(
        "break_index", F.try_element_at("break_indices", F.lit(1)))
    out = shape(chow(series), "chow", "f", F.col("p_value"), F.col("significant"))
    for part in (
        shape(cusum(series), "cusum", "max_cusum", null, F.col("rejects_stability")),
        shape(zivot_andrews(series), "zivot_andrews", "statistic", F.col("p_value"),
              F.col("stationary_with_break")),
        shape(_break_dates(series, chosen), "bai_perron", "n_breaks", null, F.col("n_breaks") > 0),
        shape(mean_shift(series), "shift_in_means", "t", F.col("p_value"), F.col("significant")),
    ):
        out = out.unionByName(part)
    return out


def detected_breaks(tests: DataFrame) -> DataFrame:
    """The significant single-break results with their chart labels."""
    # Labels of the tests in charts.
    labels = {"chow": "Chow", "cusum": "CUSUM", "zivot_andrews": "ZA", "shift_in_means": "Shift"}
    names = F.create_map(*[v for k, label in labels.items() for v in (F.lit(k), F.lit(label))])
    hit = tests.where(F.col("significant") & F.col("test").isin(*labels))
    return hit.withColumn("label", F.element_at(names, F.col("test"))).drop("significant", "error")
