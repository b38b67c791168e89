"""Time-series tests against direct numpy computations on whole arrays."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.functions.critical import adf_critical, adf_p_value
from plumbline.functions.loess import reach
from plumbline.operators import autocorrelation, breaks, seasonal, stationarity


@pytest.fixture(scope="module")
def series(make_series, noise):
    return make_series(block_rows=64, **noise)


def by_key(df):
    return {r.k: r for r in df.collect()}


def fit(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def direct_acf(x, top):
    v = x - x.mean()
    return np.array([v[k:] @ v[:len(v) - k] for k in range(top + 1)])


def test_acf_pacf_ljung_box(series, noise):
    got = autocorrelation.acf(series).toPandas()
    lb = by_key(autocorrelation.ljung_box(series))
    for k, x in noise.items():
        g, n = got[got.k == k].sort_values("lag"), len(x)
        c = direct_acf(x, 12)
        assert np.allclose(g.acf, c / c[0])
        for p in (1, 3, 12):
            for name, r in (("pacf", c / (n - np.arange(13))), ("pacf_ywm", c / n)):
                m = np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)])
                assert np.isclose(g[name].iloc[p], np.linalg.solve(m, r[1:p + 1])[-1])
        q = n * (n + 2) * sum((c[i] / c[0]) ** 2 / (n - i) for i in range(1, 13))
        assert np.isclose(lb[k].statistic, q)


def test_arch(series, noise):
    got = by_key(autocorrelation.arch_lm(series))
    for k, x in noise.items():
        v = x**2
        z = np.column_stack([np.ones(len(v) - 5)] + [v[5 - j:len(v) - j] for j in range(1, 6)])
        _, e = fit(z, v[5:])
        m = len(v) - 5
        r2 = 1 - e @ e / ((v[5:] - v[5:].mean()) ** 2).sum()
        assert np.isclose(got[k].lm, m * r2) and np.isclose(got[k].f, (r2 / 5) / ((1 - r2) / (m - 6)))


def direct_df(x, p, reg):
    d, t = np.diff(x), np.arange(p + 1, len(x))
    z = [np.ones(len(t))] + ([t.astype(float)] if reg == "ct" else []) + [x[t - 1]] + [d[t - 1 - j] for j in range(1, p + 1)]
    z = np.column_stack(z)
    y = d[t - 1]
    b, e = fit(z, y)
    i = 1 + (reg == "ct")
    se = np.sqrt(np.linalg.inv(z.T @ z)[i, i] * (e @ e) / (len(y) - z.shape[1]))
    return b[i] / se, e, se, z, y


def direct_aic_lag(x, reg):
    n = len(x)
    top = min(n // 2 - len(reg) - 1, int(np.ceil(12 * (n / 100) ** 0.25)))
    _, _, _, z, y = direct_df(x, top, reg)
    base = z.shape[1] - top
    scores = []
    for p in range(top + 1):
        _, e = fit(z[:, :base + p], y)
        scores.append(len(y) * (np.log(2 * np.pi) + np.log(e @ e / len(y)) + 1) + 2 * (base + p))
    return int(np.argmin(scores))


@pytest.mark.parametrize("reg", ["c", "ct"])
def test_adf(series, noise, reg):
    got = by_key(stationarity.adf(series, reg))
    for k, x in noise.items():
        p = direct_aic_lag(x, reg)
        assert got[k].lags == p and np.isclose(got[k].statistic, direct_df(x, p, reg)[0])
        assert got[k].n_obs == len(x) - 1 - p


def test_published_adf_values():
    # Sunspot series: statistic -2.8378 with 300 observations.
    assert abs(adf_p_value(-2.837781, "c") - 0.0531) < 1e-4
    assert abs(adf_critical("c", 300)["1%"] + 3.4523) < 1e-4


def direct_long_run(r, top):
    n = len(r)
    return (r @ r + 2 * sum((r[i:] @ r[:n - i]) * (1 - i / (top + 1)) for i in range(1, top + 1))) / n


@pytest.mark.parametrize("reg", ["c", "ct"])
def test_kpss(series, noise, reg):
    got = by_key(stationarity.kpss(series, reg))
    for k, x in noise.items():
        n, t = len(x), np.arange(len(x))
        r = x - x.mean() if reg == "c" else x - np.polyval(np.polyfit(t, x, 1), t)
        top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n - 1)
        stat = (r.cumsum() ** 2).sum() / n**2 / direct_long_run(r, top)
        assert np.isclose(got[k].statistic, stat) and got[k].lags == top
    if reg == "c":
        assert got["walk"].p_value == 0.01 and not got["walk"].stationary


def test_phillips_perron(series, noise):
    got = by_key(stationarity.phillips_perron(series))
    for k, x in noise.items():
        t, e, se, _, y = direct_df(x, 0, "c")
        n = len(y)
        top = int(np.ceil(12 * (len(x) / 100) ** 0.25))
        g0, lr, s = e @ e / n, direct_long_run(e, top), np.sqrt(e @ e / (n - 2))
        want = np.sqrt(g0 / lr) * t - 0.5 * (lr - g0) / np.sqrt(lr) * n * se / s
        assert np.isclose(got[k].statistic, want) and got[k].lags == top
    assert not got["walk"].stationary


def test_guards(make_series):
    s = make_series(nine=np.arange(9.0) % 2, flat=np.ones(40), twenty=np.sin(np.arange(20.0)))
    assert all(r.error for r in stationarity.adf(s).where("k IN ('nine', 'flat')").collect())
    assert all(r.error for r in autocorrelation.acf(s).where("k IN ('nine', 'flat')").collect())
    tests = breaks.break_tests(s).where("k <> 'flat'").collect()
    assert len(tests) == 10 and all(r.error for r in tests)


def line_rss(y, a, b):
    t = np.arange(a, b)
    return (fit(np.c_[np.ones(b - a), t], y[a:b])[1] ** 2).sum()


def test_chow(series, noise):
    got = breaks.chow_scan(series).toPandas()
    best = by_key(breaks.chow(series))
    for k, y in noise.items():
        n = len(y)
        m = max(10, int(n * 0.1))
        splits = np.linspace(m, n - m, 20, dtype=int)
        f = []
        for c in splits:
            parts = line_rss(y, 0, c) + line_rss(y, c, n)
            f.append(((line_rss(y, 0, n) - parts) / 2) / (parts / (n - 4)))
        g = got[got.k == k].sort_values("candidate")
        assert g.break_index.tolist() == splits.tolist() and np.allclose(g.f, f)
        assert best[k].break_index == splits[int(np.argmax(f))]
    assert abs(best["step"].break_index - 120) <= 8 and best["step"].significant


def test_mean_shift(series, noise):
    best = by_key(breaks.mean_shift(series))
    for k, y in noise.items():
        n = len(y)
        m = max(5, int(n * 0.1))
        splits = np.unique(np.linspace(m, n - m, 50, dtype=int))
        t = [(y[:c].mean() - y[c:].mean()) / np.sqrt(y[:c].var(ddof=1) / c + y[c:].var(ddof=1) / (n - c)) for c in splits]
        i = int(np.argmax(np.abs(t)))
        assert best[k].break_index == splits[i] and np.isclose(best[k].t, t[i])
        assert np.isclose(best[k].mean_after, y[splits[i]:].mean())


def test_cusum(series, noise):
    got = by_key(breaks.cusum(series))
    for k, y in noise.items():
        r = []
        for i in range(3, len(y)):
            b, _ = fit(np.c_[np.ones(i), np.arange(i)], y[:i])
            r.append(y[i] - b[0] - b[1] * i)
        path = np.cumsum(r) / np.std(r, ddof=1) / np.sqrt(len(r))
        assert np.isclose(got[k].max_cusum, np.abs(path).max()) and got[k].break_index == 3 + np.argmax(np.abs(path))


def direct_za(x, p, model, trim=0.15):
    n, d, cut = len(x), np.diff(x), int(len(x) * trim)
    best = (np.inf, -1)
    for bp in range(cut + 1, n - cut + 1):
        t = np.arange(p + 1, n)
        z = [np.ones(len(t)), t, x[t - 1]] + [d[t - 1 - j] for j in range(1, p + 1)]
        if model in ("c", "ct"):
            z.append((t >= bp) * 1.0)
        if model in ("t", "ct"):
            z.append(np.where(t >= bp, t - bp + 1.0, 0.0))
        z = np.column_stack(z)
        b, e = fit(z, d[t - 1])
        s = b[2] / np.sqrt(np.linalg.inv(z.T @ z)[2, 2] * (e @ e) / (len(t) - z.shape[1]))
        best = min(best, (s, bp - 1))
    return best


@pytest.mark.parametrize("model", ["c", "t", "ct"])
def test_zivot_andrews(series, noise, model):
    got = by_key(breaks.zivot_andrews(series, model))
    for k in ("step", "walk", "wave"):
        stat, at = direct_za(noise[k], direct_aic_lag(noise[k], "ct"), model)
        assert np.isclose(got[k].statistic, stat, rtol=1e-6) and got[k].break_index == at


def direct_segments(y, k, size):
    """Smallest residual sum with k breaks by plain recursion over all positions."""
    from functools import lru_cache

    @lru_cache(None)
    def best(k, j):
        if k == 0:
            return (((y[:j] - y[:j].mean()) ** 2).sum(), ()) if j >= size else (np.inf, ())
        return min(((best(k - 1, c)[0] + ((y[c:j] - y[c:j].mean()) ** 2).sum(), best(k - 1, c)[1] + (c,))
                    for c in range(k * size, j - size + 1)), default=(np.inf, ()))

    return best(k, len(y))


def test_bai_perron(make_series):
    rng = np.random.default_rng(4)
    y = np.r_[rng.normal(0, 1, 25), rng.normal(4, 1, 20), rng.normal(1, 1, 25)]
    s = make_series(block_rows=16, a=y)
    table = breaks.bai_perron_table(s)
    got = table.toPandas().sort_values("n_breaks")
    bic = []
    for k in range(4):
        rss, path = direct_segments(y, k, 7)
        assert np.isclose(got.rss.iloc[k], rss) and list(got.break_indices.iloc[k]) == list(path)
        bic.append(len(y) * np.log(rss / len(y)) + k * np.log(len(y)))
    assert np.allclose(got.bic.iloc[:4], bic)
    chosen = got[got.selected].iloc[0]
    assert chosen.n_breaks == 2 and abs(chosen.break_indices[0] - 25) <= 1 and abs(chosen.break_indices[1] - 45) <= 1
    seg = breaks.bai_perron_segments(s, table).toPandas().sort_values("segment")
    ends = [0, *chosen.break_indices, len(y)]
    for i, r in enumerate(seg.itertuples()):
        part = y[ends[i]:ends[i + 1]]
        assert r.n_obs == len(part) and np.isclose(r.mean, part.mean()) and np.isclose(r.std, part.std(ddof=1))


def test_bai_perron_uses_every_point_of_a_long_series(make_series):
    rng = np.random.default_rng(11)
    y = np.r_[rng.normal(0, 1, 1777), rng.normal(3, 1, 1601), rng.normal(1, 1, 1422)]
    got = breaks.bai_perron_table(make_series(block_rows=1024, a=y), max_breaks=2).where("n_breaks = 2").first()
    s, q = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    size, ends = 480, np.arange(len(y) + 1)
    best = min((cost(0, c) + float(rest.min()), c, int(d[rest.argmin()])) for c in range(size, len(y) - 2 * size + 1)
               for d in [ends[c + size:len(y) - size + 1]] for rest in [cost(c, d) + cost(d, len(y))])
    assert np.isclose(got.rss, best[0]) and list(got.break_indices) == [best[1], best[2]]


def test_bundle_and_labels(series):
    tests = breaks.break_tests(series)
    names = {(r.k, r.test) for r in tests.collect()}
    assert len(names) == 20
    assert ("step", "Chow") in {(r.k, r.label) for r in breaks.detected_breaks(tests).collect()}
    both = {(r.k, r.test) for r in stationarity.stationarity(series).collect()}
    assert len(both) == 16


# ------------------------------------------------------------------ STL

def scalar_fit(y, span, x, lo, hi, w):
    """One local fit, point by point, positions counted from 1."""
    n = len(y)
    h = max(x - lo, hi - x) + (max(span - n, 0)) // 2
    pos = np.arange(lo, hi + 1)
    wt = np.zeros(len(pos))
    for i, p in enumerate(pos):
        r = abs(p - x)
        if r <= 0.999 * h:
            wt[i] = 1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3
    if w is not None:
        wt *= w[lo - 1:hi]
    if wt.sum() <= 0:
        return None
    wt /= wt.sum()
    mid = (wt * pos).sum()
    c = (wt * (pos - mid) ** 2).sum()
    if h > 0 and np.sqrt(c) > 0.001 * (n - 1):
        wt *= (x - mid) / c * (pos - mid) + 1
    return (wt * y[lo - 1:hi]).sum()


def scalar_smooth(y, span, w=None):
    n, half, out = len(y), (span + 1) // 2, []
    for i in range(1, n + 1):
        lo = 1 if span >= n else min(max(1, i - half + 1), n - span + 1)
        v = scalar_fit(y, span, i, lo, min(lo + span - 1, n), w)
        out.append(y[i - 1] if v is None else v)
    return np.array(out)


def scalar_stl(y, p, outer=15):
    n = len(y)
    odd = lambda v: int(np.ceil(v)) + (int(np.ceil(v)) % 2 == 0)
    nt, nl = odd(1.5 * p / (1 - 1.5 / 7)), odd(p + 1)
    trend, w = np.zeros(n), None
    ma = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(outer + 1):
        for _ in range(2):
            cyc = np.zeros(n + 2 * p)
            for j in range(p):
                sub, ws = (y - trend)[j::p], None if w is None else w[j::p]
                k, f = len(sub), scalar_smooth((y - trend)[j::p], 7, ws)
                a = scalar_fit(sub, 7, 0, 1, min(7, k), ws)
                b = scalar_fit(sub, 7, k + 1, max(1, k - 6), k, ws)
                cyc[j::p][:k + 2] = np.r_[f[0] if a is None else a, f, f[-1] if b is None else b]
            season = cyc[p:-p] - scalar_smooth(ma(ma(ma(cyc, p), p), 3), nl)
            trend = scalar_smooth(y - season, nt, w)
        r = np.abs(y - trend - season)
        top = 6 * np.median(r)
        w = np.where(r <= 0.001 * top, 1.0, np.where(r <= 0.999 * top, (1 - (r / top) ** 2) ** 2, 0.0))
    return trend, season


@pytest.fixture(scope="module")
def weekly():
    rng = np.random.default_rng(8)
    t = np.arange(200)
    y = 3 * np.sin(2 * np.pi * t / 7) + 0.05 * t + rng.normal(size=200) * 0.3
    y[50] += 20
    return y


def test_stl_matches_pointwise_version(make_series, weekly):
    trend, season = scalar_stl(weekly, 7)
    got = seasonal.stl(make_series(a=weekly), 7).orderBy("t").toPandas()
    assert np.allclose(got.trend, trend) and np.allclose(got.seasonal, season)
    assert np.allclose(got.y, got.trend + got.seasonal + got.resid)


def test_stl_by_blocks_equals_whole(make_series, weekly):
    whole = seasonal.stl(make_series(a=weekly), 7).orderBy("t").toPandas()
    block = 25
    assert reach(7) < 200 - block              # the halo is a real cut for some blocks
    parts = seasonal.stl(make_series(block_rows=block, a=weekly), 7, group_rows=100).orderBy("t").toPandas()
    assert np.allclose(parts.trend, whole.trend) and np.allclose(parts.seasonal, whole.seasonal)


def test_seasonal_strength(make_series, weekly, spark):
    rng = np.random.default_rng(9)
    s = make_series(a=weekly, noise=rng.normal(size=200), tiny=np.arange(5.0))
    got = by_key(seasonal.seasonal_strength(s, 7))
    assert got["a"].seasonal_strength > 0.6 > got["noise"].seasonal_strength and got["tiny"].error
    periods = spark.createDataFrame([("a", 7), ("noise", None), ("tiny", 7)], "k string, period int")
    assert by_key(seasonal.seasonal_strength(s, periods))["noise"].error
