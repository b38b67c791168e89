"""Ranks, quantiles, ordered series and prefix sums against numpy, with heavy skew and many ties."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import tables
from plumbline.functions.runs import explode_range, quantiles, ranked_runs
from plumbline.functions.series import running_sums, with_halo


def skewed(spark, n=6000):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n)),
                        "v": np.where(rng.random(n) < 0.35, 5.0, np.round(rng.normal(size=n), 2))})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_start_and_total_match_a_sort(spark):
    pdf, df = skewed(spark)
    got = ranked_runs(df, ["k"], ["v"]).toPandas()
    for k, g in got.groupby("k"):
        v = np.sort(pdf.v[pdf.k == k].to_numpy())
        g = g.sort_values("v")
        assert g.start.tolist() == [int((v < x).sum()) for x in g.v]
        assert g.copies.tolist() == [int((v == x).sum()) for x in g.v]
        assert set(g.total) == {len(v)}
        assert g.prev.iloc[1:].tolist() == g.v.iloc[:-1].tolist() and np.isnan(g.prev.iloc[0])
    assert got.groupby("k").chunk.nunique()["hot"] > 1      # one key is spread over partitions


def test_weighted_sums(spark):
    pdf, df = skewed(spark, 2000)
    got = ranked_runs(df, ["k"], ["v"], {"s": F.col("v") * F.col("copies")}).select("k", "s", "s_at").distinct().toPandas()
    for k, g in got.groupby("k"):
        v = np.sort(pdf.v[pdf.k == k].to_numpy())
        assert np.allclose(g.s, v.sum()) and np.allclose(g.s_at, (v * np.arange(len(v))).sum())


def test_quantiles(spark):
    pdf, df = skewed(spark)
    got = quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).toPandas().set_index("k")
    for k in got.index:
        want = np.quantile(pdf.v[pdf.k == k], [0.25, 0.5, 0.9])
        assert np.allclose(got.loc[k, ["q1", "m", "q9"]].to_numpy(float), want)


def test_series_positions_keep_repeats(spark, make_series):
    s = make_series(block_rows=7, a=np.arange(50.0)[::-1], b=[1.0] * 20)
    a = s.rows.where("k = 'a'").orderBy("t").toPandas()
    assert a.t.tolist() == list(range(50)) and a.y.tolist() == list(np.arange(50.0)[::-1])
    assert np.allclose(a.slope, -1) and np.allclose(a["mean"], 24.5) and (a.block == a.t // 7).all()


def test_copies_of_one_row_become_positions(spark):
    from plumbline.functions.series import order_series
    df = spark.range(1000).select(F.lit("x").alias("series"), F.when(F.col("id") < 700, F.lit("2024-01-02")).otherwise(
        F.lit("2024-01-01")).cast("timestamp_ntz").alias("ts"), F.lit(3.0).alias("y"))
    s = order_series(df, ["series"], block_rows=64)
    rows = s.rows.orderBy("t").toPandas()
    assert rows.t.tolist() == list(range(1000)) and (rows.ts.diff().dropna() >= pd.Timedelta(0)).all()
    assert rows.groupby("block").size().max() == 64


def test_running_sums_and_halo(make_series, noise):
    s = make_series(block_rows=16, **{k: noise[k] for k in ("step", "short")})
    got = running_sums(s, s.rows, {"c": F.col("y")}).orderBy("t").toPandas()
    for k in ("step", "short"):
        assert np.allclose(got.c[got.k == k], np.cumsum(noise[k]))
    halo = with_halo(s, s.rows, 20, 3).where("k = 'step'").toPandas()
    for b, g in halo.groupby("block"):
        assert sorted(g.t) == list(range(max(0, b * 16 - 20), min(200, b * 16 + 19)))
        assert sorted(g.t[g.core]) == list(range(b * 16, min(200, b * 16 + 16)))


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 3, 10), (2, 5, 4), (3, 0, 0)], "k int, a long, b long")
    got = explode_range(df, F.col("a"), F.col("b"), "i", step=4).toPandas()
    assert sorted(got.i[got.k == 1]) == list(range(3, 11)) and 2 not in set(got.k) and got.i[got.k == 3].tolist() == [0]


def test_lookup_splits_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_GROUPS", 3)
    pdf, df = skewed(spark, 3000)
    groups = tables.write_table(df.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")))
    got = tables.lookup(df, groups, ["v"], "n", ["n", "s"]).toPandas()
    assert len(got) == 3000 and np.allclose(got.n, got.v.map(pdf.v.value_counts())) and np.allclose(got.s, got.v * got.n)
