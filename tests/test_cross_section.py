"""Descriptive statistics and regression diagnostics against pandas and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import tails
from plumbline.operators import describe, feeds, regression, shapiro


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 700
    x1 = rng.normal(5, 2, n)
    x2 = 2 * x1 + rng.normal(0, 0.5, n)
    return pd.DataFrame({"y": 3 + x1 - 0.5 * x2 + rng.normal(0, 1, n) * (0.2 + np.abs(x1)), "x1": x1, "x2": x2,
                         "flat": 4.0, "ties": rng.integers(0, 4, n).astype(float), "heavy": np.exp(rng.normal(size=n))})


@pytest.fixture(scope="module")
def df(spark, pdf):
    with_nulls = pdf.copy()
    return spark.createDataFrame(with_nulls).repartition(6)


def test_describe(df, pdf):
    got = describe.describe(df).toPandas().set_index("column")
    for c in ("y", "x1", "ties", "heavy"):
        want = [pdf[c].mean(), pdf[c].std(), pdf[c].skew(), pdf[c].kurtosis()]
        assert np.allclose(got.loc[c, ["mean", "std", "skewness", "kurtosis"]].to_numpy(float), want)
    assert got.loc["flat", "std"] == 0 and got.loc["flat", "skewness"] == 0


def test_small_samples(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "a double, b double")
    got = describe.describe(df).toPandas().set_index("column")
    assert got.loc["a", "n"] == 1 and np.isnan(got.loc["a", "std"])
    assert describe.jarque_bera(df).toPandas().error.notna().all()
    assert describe.correlation(df).toPandas().error.notna().all()


def test_outliers(df, pdf):
    got = describe.outliers(df).toPandas().set_index("column")
    for c in ("y", "heavy"):
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert np.allclose(got.loc[c, ["lower", "upper"]].to_numpy(float), [lo, hi])
        assert got.loc[c, "n_outliers"] == ((pdf[c] < lo) | (pdf[c] > hi)).sum()
    z = describe.outliers(df, ["heavy"], "zscore").first()
    assert z.n_outliers == (((pdf.heavy - pdf.heavy.mean()) / pdf.heavy.std(ddof=0)).abs() > 3).sum()


def test_correlation(df, pdf):
    for method in ("pearson", "spearman"):
        want = pdf[["y", "x1", "ties", "heavy"]].corr(method=method).round(4)
        got = describe.correlation(df, list(want.columns), method).toPandas()
        for r in got.itertuples():
            assert abs(r.r - want.loc[r.col_a, r.col_b]) < 1.01e-4


def test_vif_and_condition_number(df, pdf):
    got = {r["column"]: r.vif for r in regression.vif(df, ["x1", "x2", "ties", "flat"]).collect()}
    assert set(got) == {"x1", "x2", "ties"}
    want = np.diag(np.linalg.inv(pdf[["x1", "x2", "ties"]].corr()))
    assert np.allclose([got["x1"], got["x2"], got["ties"]], want)
    x = np.c_[np.ones(len(pdf)), pdf[["x1", "x2"]]]
    s = np.linalg.svd(x, compute_uv=False)
    assert np.isclose(regression.condition_number(df, ["x1", "x2"]).first()[1], s[0] / s[-1])


def test_collinear_columns(spark):
    a = np.arange(50.0)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": 2 * a, "c": np.sin(a)}))
    got = {r["column"]: r.vif for r in regression.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] is None and got["b"] is None and got["c"] >= 1


def _lstsq(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def test_ols_breusch_pagan_white(df, pdf):
    n = len(pdf)
    x = np.c_[np.ones(n), pdf[["x1", "x2"]]]
    b, e = _lstsq(x, pdf.y.to_numpy())
    got = regression.ols(df, "y", ["x1", "x2"]).toPandas().set_index("term")
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (n - 3))
    assert np.allclose(got.loc[["const", "x1", "x2"], "coef"], b) and np.allclose(got.std_err, se)
    e2 = e**2
    i, j = np.triu_indices(3)
    het = regression.heteroskedasticity(df, "y", ["x1", "x2"]).toPandas().set_index("test")
    for name, z in (("breusch_pagan", x), ("white", x[:, i] * x[:, j])):
        _, r = _lstsq(z, e2)
        r2 = 1 - r @ r / ((e2 - e2.mean()) ** 2).sum()
        assert np.isclose(het.loc[name, "lm"], n * r2)
        k = z.shape[1] - 1
        assert np.isclose(het.loc[name, "f"], (r2 / k) / ((1 - r2) / (n - k - 1))) and het.loc[name, "lm_p"] < 0.05


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "y double, x double")
    assert regression.heteroskedasticity(df, "y", ["x"]).first().error


def test_published_shapiro_values():
    # Shapiro and Wilk (1965), example of eleven weights; p-value of algorithm AS R94.
    w, p = shapiro.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert abs(w - 0.78881) < 1e-4 and abs(p - 0.0067) < 1e-4
    w, p = shapiro.shapiro_wilk(np.array([1.0, 2.0, 3.0]))
    assert abs(w - 1) < 1e-9 and abs(p - 1) < 1e-6


def test_shapiro_on_columns(spark, df):
    got = shapiro.shapiro(df, ["x1", "heavy"]).toPandas().set_index("column")
    assert got.loc["x1", "is_normal"] and not got.loc["heavy", "is_normal"]
    assert set(got.n_used) == {df.count()}


def test_shapiro_by_sums_equals_shapiro_at_hand(spark, monkeypatch):
    monkeypatch.setattr(shapiro, "PIECE", 7)
    rng = np.random.default_rng(2)
    arrays = {"normal": rng.normal(50, 3, 700), "ties": rng.integers(0, 4, 300) * 1.0, "three": np.array([1.0, 5.0, 2.0]), "four": np.array([1.0, 2.0, 4.0, 8.0]),
              "five": np.array([1.0, 2.0, 4.0, 8.0, 8.5]), "seven": rng.random(7), "flat": np.full(9, 2.0), "two": np.array([1.0, 2.0]), "many": rng.exponential(size=6000)}
    rows = pd.DataFrame({k: pd.Series(v) for k, v in arrays.items()})
    got = {r["column"]: r for r in shapiro.shapiro(spark.createDataFrame(rows).repartition(5)).collect()}
    for name, values in arrays.items():
        assert got[name].n_used == len(values) and got[name].large_sample == (len(values) > 5000)
        if name == "two":
            assert got[name].error
            continue
        w, p = shapiro.shapiro_wilk(values)
        assert abs(got[name].statistic - w) < 1e-10 and abs(got[name].p_value - p) < 1e-8, name
    # Weights as published for n = 10 (Shapiro and Wilk 1965, table 5): close to Royston's approximation.
    base = np.zeros(10)
    base[-1] = 1.0
    w, _ = shapiro.shapiro_wilk(base)
    assert abs(w - 0.5739 ** 2 / 0.9) < 2e-3


def test_normal_quantiles():
    from statistics import NormalDist
    p = np.r_[np.linspace(1e-9, 1 - 1e-9, 501), 1e-13, 0.0750001, 0.925]
    assert np.allclose(shapiro.normal_quantiles(p), [NormalDist().inv_cdf(x) for x in p], rtol=1e-12, atol=1e-13)


@pytest.mark.parametrize("got, want", [
    (tails.chi2_sf(3.841459, 1), 0.05), (tails.chi2_sf(18.30704, 10), 0.05), (tails.chi2_sf(23.209, 10), 0.01),
    (tails.f_sf(2.7109, 5, 20), 0.05), (tails.f_sf(3.4928, 2, 20), 0.05), (tails.t_two_sided(2.228139, 10), 0.05),
    (tails.t_two_sided(1.959964, 1e7), 0.05), (tails.normal_cdf(1.959964), 0.975)])
def test_published_tails(got, want):
    assert abs(float(got) - want) < 1e-4


def test_f_with_two_degrees_has_closed_form():
    f, d = np.array([0.1, 1.0, 3.0, 20.0]), 76
    assert np.allclose(tails.f_sf(f, 2, d), (1 + 2 * f / d) ** (-d / 2))


def test_feeds(df, pdf):
    pts = feeds.scatter_pairs(df, ["y", "x1", "x2"], max_rows=100).toPandas()
    assert set(pts.pair) == {0, 1, 2} and (pts.groupby("pair").size() == 100).all()
    box = feeds.box_summary(df, ["heavy"]).first()
    assert np.isclose(box.q3, pdf.heavy.quantile(0.75)) and box.whisker_high <= box.q3 + 1.5 * (box.q3 - box.q1)
    assert box.n == len(pdf) and box.n_outliers == (pdf.heavy > box.q3 + 1.5 * (box.q3 - box.q1)).sum()
