"""Date coverage against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import calendar
from plumbline.operators import dates

FREQS = ["D", "2D", "W-SUN", "2W-TUE", "MS", "ME", "2MS", "QS-OCT", "QE-DEC", "QS-NOV", "YS-JAN", "YE-DEC", "YS-MAR",
         "h", "6h", "min", "15min", "s", "B"]


def frame(spark, groups):
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": pd.DatetimeIndex(v)}) for k, v in groups.items()])
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5)


def test_frequency_names(spark):
    groups = {f: pd.date_range("2020-01-01", periods=30, freq=f) for f in FREQS}
    rng = np.random.default_rng(0)
    groups["irregular"] = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 9000, 30), "h")
    groups["repeats"] = list(pd.date_range("2020-01-01", periods=5)) * 2
    groups["two"] = pd.to_datetime(["2020-01-01", "2020-01-08"])
    groups["one"] = pd.to_datetime(["2020-01-01"])
    got = {r.k: r for r in dates.infer_frequency(dates.date_runs(frame(spark, groups), "ts", ["k"])).collect()}
    for f in FREQS:
        assert got[f].freq_exact == pd.infer_freq(groups[f]), f
    assert got["irregular"].freq_exact is None and got["repeats"].freq_exact is None
    assert got["two"].freq_exact is None and got["two"].freq == "W" and got["one"].error
    assert got["MS"].seasonal_period == 12 and got["W-SUN"].seasonal_period == 52 and got["QE-DEC"].seasonal_period == 4
    assert got["YS-JAN"].seasonal_period == 1 and got["D"].seasonal_period == 7 and got["h"].seasonal_period is None


@pytest.mark.parametrize("freq", ["D", "W-MON", "W", "MS", "ME", "QS", "QE", "YS", "YE", "2D", "2MS", "12h", "YE-JUN", "QS-FEB"])
def test_missing_dates(spark, freq):
    rng = np.random.default_rng(2)
    days = pd.date_range("2020-03-07", "2023-02-20")
    groups = {"a": days[rng.random(len(days)) < 0.6], "b": pd.DatetimeIndex(["2021-01-31", "2021-01-31", "2022-12-31"])}
    runs = dates.date_runs(frame(spark, groups), "ts", ["k"])
    got = dates.missing_dates(runs, freq).toPandas()
    counts = dates.missing_date_counts(runs, freq).toPandas().set_index("k")
    for k, v in groups.items():
        grid = pd.date_range(v.min(), v.max(), freq=freq)
        want = grid.difference(v.unique())
        assert sorted(got.missing_ts[got.k == k]) == sorted(want)
        assert counts.loc[k, "missing_count"] == len(want) and counts.loc[k, "expected_length"] == len(grid)


def test_unknown_frequency():
    with pytest.raises(ValueError):
        calendar.grid_of("fortnight")


def test_deltas_and_gaps(spark):
    v = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-02 13:00", "2024-01-03", "2024-01-10", "2024-01-10"], format="mixed")
    df = frame(spark, {"a": v, "lonely": v[:1]})
    runs = dates.date_runs(df, "ts", ["k"])
    deltas = pd.Series(v).diff().dropna().dt.round("D").dt.days
    hist = {r.delta_days: r.n for r in dates.delta_counts(runs).collect()}
    assert hist == deltas.value_counts().to_dict()
    freq = {r.k: r for r in dates.frequency(runs).collect()}
    assert freq["a"].median_days == deltas.median() and not freq["a"].is_regular and freq["lonely"].error
    gaps = dates.gaps(runs).collect()
    assert len(gaps) == 1 and gaps[0].delta_days == 7


def test_whole_table_without_keys(spark):
    df = frame(spark, {"a": pd.date_range("2024-01-01", periods=5)})
    runs = dates.date_runs(df, "ts")
    assert dates.infer_frequency(runs).first().freq == "D" and dates.infer_frequency(runs).columns[0] == "start"
    assert dates.missing_dates(runs, "D").count() == 0


def test_fill_gaps(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-04", 4.0), ("2024-01-05", None)], "d string, y double")
    get = lambda a: [(r.y, r.is_filled) for r in dates.fill_gaps(df, "d", "y", "D", a).orderBy("ts").collect()]
    assert get("drop") == [(1.0, False), (4.0, False)]
    assert get("ignore") == [(1.0, False), (None, True), (None, True), (4.0, False)]
    assert get("forward_fill") == [(1.0, False), (1.0, True), (1.0, True), (4.0, False)]
    assert get("interpolate") == [(1.0, False), (2.0, True), (3.0, True), (4.0, False)]
