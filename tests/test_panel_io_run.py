"""Panels, readers, writers, findings and whole validation runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import panel
from plumbline.plans import findings as fd
from plumbline.plans.config import ValidationConfig
from plumbline.plans.validate import validate
from plumbline.sources import readers, sinks


@pytest.fixture(scope="module")
def gdp():
    rng = np.random.default_rng(6)
    rows = []
    for i, c in enumerate(["AT", "BE", "CZ"]):
        for m in pd.date_range("2018-01-01", periods=48, freq="MS"):
            if not (c == "CZ" and m.month == 6 and m.year == 2019):
                rows.append((c, m.strftime("%Y-%m-%d"), 100.0 * i + rng.normal(), rng.normal()))
    return pd.DataFrame(rows, columns=["country", "date", "gdp_billion", "inflation_pct"])


def test_panel_operators(spark, gdp):
    df = spark.createDataFrame(gdp).repartition(4)
    b = panel.balance(df, "country", "date").first()
    assert (b.n_entities, b.n_time_periods, b.actual_obs, b.is_balanced) == (3, 48, 143, False)
    assert b.balance_ratio == round(143 / 144, 4)
    v = panel.variance_decomposition(df, "country", ["gdp_billion"]).first()
    means = gdp.groupby("country").gdp_billion
    assert np.isclose(v.overall_variance, gdp.gdp_billion.var(), atol=1e-5)
    assert np.isclose(v.between_variance, means.mean().var(), atol=1e-5)
    assert np.isclose(v.within_variance, means.var().mean(), atol=1e-5)
    freq = {r.country: r for r in panel.panel_frequency(df, "country", "date").collect()}
    assert all(r.matches for r in freq.values()) and freq["AT"].dominant == 31
    levels = panel.panel_ranges(df, "country", "date").groupBy("level").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in levels} == {"entity": 143, "panel": 143}
    assert panel.snapshot(df, "country", "date", "gdp_billion", max_entities=2).count() == 2


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_messy_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id;name;v\n1;"x;y";2\n2;short\n3;a;b;c\n4;é;5\n')
    assert readers.detect_delimiter(spark, path) == ";"
    got = readers.read_table(spark, path).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 4] and got[0].name == "x;y" and got[1].v is None and got[2].name == "é"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = write(tmp_path / "b.txt", "".join(sep.join(r) + "\n" for r in (["a", "b"], ["1", "2"], ["3", "4"])))
    df = readers.read_table(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 2


def test_encodings(spark, tmp_path):
    latin = write(tmp_path / "l.csv", "n,v\ncafé,1\n", "latin-1")
    utf = write(tmp_path / "u.csv", "﻿n,v\ncafé,1\n")
    assert readers.detect_encoding(spark, latin) == "ISO-8859-1" and readers.detect_encoding(spark, utf) == "UTF-8"
    assert readers.read_table(spark, latin).first().n == "café"
    assert readers.read_table(spark, utf).columns == ["n", "v"] and readers.read_table(spark, utf).first().n == "café"


def test_json_and_advice(spark, tmp_path):
    path = write(tmp_path / "c.json", '[{"a": 1, "b": "x"}, {"a": 300, "b": null}]')
    df = readers.read_table(spark, path)
    assert df.count() == 2
    assert readers.downcast_advice(df).first().suggested_type == "smallint"
    assert dict(readers.downcast(df).dtypes)["a"] == "smallint"
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")


def test_sink_and_flatten(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1, 2.5), ("c2", None, 1.0)], "column string, n int, m double")
    sink = sinks.ResultFolder(str(tmp_path), "r1")
    sink.write("demo", df)
    assert spark.read.json(f"{tmp_path}/operator=demo").count() == 2
    flat = {(r.subject, r.metric): r.value for r in sinks.flatten("demo", df, ["column"]).collect()}
    assert flat == {("c1", "n"): "1", ("c1", "m"): "2.5", ("c2", "n"): None, ("c2", "m"): "1.0"}
    assert sinks.as_tree({"demo": df}).count() == 2


def test_star_and_severity_rules(spark):
    df = spark.createDataFrame([(0.001,), (0.03,), (0.07,), (0.5,)], "p_value double")
    got = [(r.severity, r.message) for r in fd.p_values(df, "t", F.lit("s"), F.lit("m")).orderBy("value").collect()]
    assert got == [("bad", "p = 0.0010 ***"), ("bad", "p = 0.0300 **"), ("warn", "p = 0.0700 *"), ("ok", "p = 0.5000")]


def test_panel_run(spark, gdp, tmp_path):
    sink = sinks.ResultFolder(str(tmp_path), "r1", "parquet")
    res = validate(spark.createDataFrame(gdp), ValidationConfig(panel_frequency="MS"), sink)
    assert res["dataset_type"].first().dataset_type == "panel"
    broken = [k for k, v in res.items() if v.columns == ["operator", "error"]]
    assert broken == []
    assert res["stationarity"].count() == 3 * 2 * 4 and res["structural_breaks"].count() == 3 * 2 * 5
    counts = {r.country: r.missing_count for r in res["missing_date_counts"].collect()}
    assert counts == {"AT": 0, "BE": 0, "CZ": 1}
    kinds = {r.operator for r in res["findings"].select("operator").distinct().collect()}
    assert {"ljung_box", "stationarity", "structural_breaks", "seasonal_strength", "arch_lm", "summary"} <= kinds
    assert spark.read.parquet(f"{tmp_path}/operator=findings").count() == res["findings"].count()


def test_cross_section_run(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"y": rng.normal(size=60), "x": rng.normal(size=60), "grp": list("ab") * 30})
    res = validate(spark.createDataFrame(pdf))
    assert res["dataset_type"].first().dataset_type == "cross_sectional"
    assert [k for k, v in res.items() if v.columns == ["operator", "error"]] == []
    assert {"describe", "outliers", "vif", "spearman", "heteroskedasticity", "findings"} <= set(res)


def test_unknown_kind_stops_with_reason(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 2.0)], "day string, v double")
    res = validate(df)
    assert res["dataset_type"].first().dataset_type == "unknown" and "findings" not in res


def test_table_without_numbers(spark):
    res = validate(spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x")], "p string, q string"))
    assert res["cross_section"].first().error == "No numeric columns"
    assert res["duplicate_rates"].first().duplicate_count == 2


def test_json_lines_and_arrays_by_content(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "b.json").write_text('[\n {"x": 4},\n {"x": 5}\n]\n')
    from plumbline.sources.readers import read_table
    assert [read_table(spark, str(tmp_path / f"{f}.json")).count() for f in "ab"] == [3, 2]
    (tmp_path / "both.json").mkdir()
    for f in "ab":
        (tmp_path / "both.json" / f"{f}.json").write_text((tmp_path / f"{f}.json").read_text())
    assert sorted(r.x for r in read_table(spark, str(tmp_path / "both.json")).collect()) == [1, 2, 3, 4, 5]


def test_over_long_lines_with_empty_fields(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,2,3\n4,5,6,\n7,8,9,,x\n10,11\n12,"x,y,z",14\n')
    from plumbline.sources.readers import read_table
    got = read_table(spark, str(path))
    assert sorted(r.a for r in got.collect()) == [1, 10, 12] and got.count() == 3
    assert sorted(r.b for r in got.select("b").collect()) == ["11", "2", "x,y,z"]


def test_snapshot_in_another_time_zone(spark):
    from plumbline.operators.panel import snapshot
    df = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-02", 2.0), ("b", "2020-01-02", 3.0)], "e string, d string, v double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert snapshot(df, "e", "d", "v").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
