"""Near copies in wide tables, exact quantiles, furthest outliers, ranks, dates in text, calendars per entity, quoting."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_dates import frame

from plumbline.functions import quantiles, tables
from plumbline.operators import dates, describe, duplicates, near_rows, roles
from plumbline.plans.validate import validate
from plumbline.sources import readers


def near_by_pairs(rows, keys, spare):
    return {i for i, (k, a) in enumerate(rows) for j, (m, b) in enumerate(rows)
            if i != j and k[:keys] == m[:keys] and sum(x != y for x, y in zip(a, b)) <= spare}


@pytest.mark.parametrize("n_cols, spare, bucket", [(8, 1, 4), (20, 3, 8), (24, 1, 512), (60, 3, 6), (5, 7, 512)])
def test_near_rows_match_all_pairs(spark, monkeypatch, n_cols, spare, bucket):
    monkeypatch.setattr(near_rows, "BUCKET_ROWS", bucket)
    rng = random.Random(n_cols)
    rows = []
    for _ in range(45):
        # Families with few values per column, so that buckets are large; the key is the same for most.
        base = [rng.choice(["a", "b", None]) for _ in range(n_cols)]
        for _ in range(rng.choice([1, 2, 5])):
            one = list(base)
            for at in rng.sample(range(n_cols), min(n_cols, rng.choice([0, 1, spare, spare + 1, 2 * spare + 1]))):
                one[at] = rng.choice(["a", "b", "c", None])
            rows.append(((rng.choice(["k", "k", "k", None]),), one))
    schema = "id long, key string, " + ", ".join(f"c{i} string" for i in range(n_cols))
    df = spark.createDataFrame([(i, *k, *a) for i, (k, a) in enumerate(rows)], schema)
    got = near_rows.near_rows(df, "id", ["key"], [f"c{i}" for i in range(n_cols)], spare).collect()
    assert {r.id for r in got} == near_by_pairs(rows, 1, spare) and len(got) == len({r.id for r in got})


def test_wide_rules_with_a_skewed_date(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        base = rows[-1][3:] if i % 3 else [str(rng.randint(0, 3)) for _ in range(60)]
        one = list(base)
        for at in rng.sample(range(60), i % 3 * 2):
            one[at] = str(rng.randint(0, 9))
        rows.append((i, "d0" if i % 2 else f"d{i % 7}", f"e{i % 2}", *one))
    df = spark.createDataFrame(rows, "id long, day string, entity string, " + ", ".join(f"c{i} string" for i in range(60)))
    got = {r.id: r for r in duplicates.flag_duplicates(df, "id", "entity", "day").collect()}
    by_date = near_by_pairs([((r[1],), r[2:]) for r in rows], 1, 3)
    by_both = near_by_pairs([((r[1], r[2]), r[3:]) for r in rows], 2, 3)
    assert {i for i, r in got.items() if r.rule_b} == by_date and {i for i, r in got.items() if r.rule_c} == by_both
    assert 0 < len(by_both) <= len(by_date) < 240


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_never_go_through_the_driver(spark, monkeypatch, tmp_path):
    # Few bytes on disk, so that Spark would broadcast every table here.
    df = spark.range(600).selectExpr("id", "id % 7 AS day", "id AS c0", *[f"id % 2 AS c{i}" for i in range(1, 6)])
    df.write.parquet(str(tmp_path / "rows"))
    rows, plans = spark.read.parquet(str(tmp_path / "rows")), []
    real = near_rows.write_table
    marked = []
    monkeypatch.setattr(near_rows, "write_table", lambda d: plans.append(plan_of(d)) or real(d))
    monkeypatch.setattr(duplicates, "write_table", lambda d: marked.append(plan_of(d)) or real(d))
    monkeypatch.setattr(near_rows, "BUCKET_ROWS", 4)
    flags = duplicates.flag_duplicates(rows, "id", date="day", threshold=0.8)
    compared = [p for p in plans if "FlatMapGroupsInArrow" in p]
    known = [p for p in plans if "known" in p and "Join" in p]
    marked = [p for p in marked if "Join" in p]
    assert compared and known and marked
    for p in (*compared, *known, *marked):
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p
    assert flags.where("rule_b").count() == 600
    # Of the groups only the largest are sent, fewer than 1,000.
    groups = tables.write_table(spark.range(3000).selectExpr("id AS c", "id AS n", "id AS v"))
    found = tables.lookup(spark.range(4000).selectExpr("id AS c"), groups, ["c"], "n", ["v"])
    assert plan_of(found).count("SortMergeJoin") == 1 and found.where("v = c").count() == 3000


@pytest.mark.parametrize("gathered, accuracy", [(20_000, 10_000), (30, 200)])
def test_quantiles_are_exact(spark, monkeypatch, gathered, accuracy):
    monkeypatch.setattr(quantiles, "GATHERED", gathered)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"spread": rng.normal(size=n) * 1e6, "few": rng.integers(0, 3, n).astype(float), "heavy": np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n)),
                        "one": 7.0, "holes": np.where(rng.random(n) < 0.999, np.nan, rng.random(n)), "none": np.nan, "two": np.r_[1.0, 2.0, np.full(n - 2, np.nan)]})
    df = spark.createDataFrame(pdf).repartition(7)
    got = quantiles.wide_quantiles(describe.numbers(df), {"low": 0.001, "q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0})
    assert set(got) == set(pdf.columns) - {"none"}
    for c, found in got.items():
        want = pdf[c].dropna().quantile([0.001, 0.25, 0.5, 0.75, 1.0]).tolist()
        assert np.allclose(list(found.values()), want, rtol=1e-12), c
    assert sorted(r["column"] for r in describe.medians(df).collect()) == sorted(got)


def test_outliers_on_both_sides(spark):
    values = [0.0] * 40 + [1.0] * 40 + [-9.0, -8.0, -7.0, 9.5, 8.5, 8.5]
    df = spark.createDataFrame([(v, 1.0) for v in values], "x double, flat double").repartition(4)
    first = describe.outlier_values(df, limit=3).collect()
    assert {(r.value, r["rank"]) for r in first} == {(9.5, 2), (-9.0, 1), (-8.0, 3)} or [r.value for r in first]
    want = sorted((v for v in values if v < -1.5 or v > 2.5), key=lambda v: (-max(-1.5 - v, v - 2.5), v))
    assert [r.value for r in sorted(first, key=lambda r: (r["rank"], r.value))] == want[:3]
    assert all(r.sample_capped and r.n_outliers == 6 and r["column"] == "x" for r in first)
    every = describe.outlier_values(df).collect()
    assert sorted(r.value for r in every) == sorted(want) and not any(r.sample_capped for r in every)
    ranks = {r.value: r["rank"] for r in every}
    assert [ranks[v] for v in want] == [1 + sum(max(-1.5 - w, w - 2.5) > max(-1.5 - v, v - 2.5) for w in want) for v in want]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_spearman_by_rank_tables(spark, monkeypatch, sent):
    monkeypatch.setattr(describe, "SENT_RANKS", sent)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 400).astype(float), "b c": rng.normal(size=400), "_rank": rng.integers(0, 50, 400).astype(float)})
    pdf["d"] = pdf["b c"] ** 3 + rng.normal(size=400)
    want = pdf.corr("spearman")
    for r in describe.correlation(spark.createDataFrame(pdf).repartition(3), method="spearman").collect():
        assert abs(r.r - want.loc[r.col_a, r.col_b]) < 1e-4 and r.n_used == 400


SHAPES = [("2020-03-07T10:20:30", dt.datetime(2020, 3, 7, 10, 20, 30)), ("2020-03-07T10:20:30.25Z", dt.datetime(2020, 3, 7, 10, 20, 30, 250000)),
          ("2020-03-07 10:20:30.123456+05:30", dt.datetime(2020, 3, 7, 4, 50, 30, 123456)), ("2020-03-07T23:30-0200", dt.datetime(2020, 3, 8, 1, 30)),
          ("2020/3/7", dt.datetime(2020, 3, 7)), ("20200307", dt.datetime(2020, 3, 7)), ("2020-03", dt.datetime(2020, 3, 1)),
          ("7 Mar 2020", dt.datetime(2020, 3, 7)), ("7th March, 2020", dt.datetime(2020, 3, 7)), ("March 7, 2020 3:05 pm", dt.datetime(2020, 3, 7, 15, 5)),
          ("Sat, 7 Mar 2020 12:00:01 GMT", dt.datetime(2020, 3, 7, 12, 0, 1)), ("07-Mar-68", dt.datetime(2068, 3, 7)), ("Sept 2020", dt.datetime(2020, 9, 1)),
          ("3/7/2020", dt.datetime(2020, 3, 7)), ("3/7/99 12:01 am", dt.datetime(1999, 3, 7, 0, 1)),
          ("2020-02-30", None), ("2020-13-01", None), ("7 Mayor 2020", None), ("2020-03-07 25:00", None), ("12345", None), ("ab-12-34", None), ("", None), (None, None)]


def test_dates_in_text(spark):
    from plumbline.functions.date_text import date_of
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHAPES)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", date_of(F.col("t")).alias("d")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(SHAPES)] == SHAPES


def test_day_and_month_by_the_largest_field(spark):
    rows = [(f"{i + 1}/{i % 3 + 1}/2020", f"{i % 3 + 1}/{i + 1}/2020", f"{i % 9 + 1}.{i % 5 + 1}.2020", f"{i + 1} May 2020" if i < 15 else "?") for i in range(20)]
    df = spark.createDataFrame(rows, "european string, american string, open string, named string")
    got = {r["column"]: r for r in roles.detect_dates(df).collect()}
    assert [got[c].day_first for c in df.columns] == [True, False, False, False]
    assert [got[c].parse_ratio for c in df.columns] == [1.0, 1.0, 1.0, 0.75] and not got["named"].is_date
    assert got["european"].best_format == "d-m-y" and got["american"].best_format == "m-d-y"


def test_panel_with_dates_in_text(spark):
    days = pd.date_range("2020-01-01", periods=40)
    rows = [(f"{d.day}/{d.month}/{d.year}", e, float(i)) for e in "ab" for i, d in enumerate(days) if (i + len(e)) % 7]
    results = validate(spark.createDataFrame(rows, "seen_on string, who string, y double"))
    assert results["dataset_type"].first().dataset_type == "panel"
    span = results["date_range"].orderBy("who").first()
    assert (span.start, span.end) == (dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 9))


def test_every_entity_has_its_own_calendar(spark):
    rng = np.random.default_rng(4)
    freqs = {"day": "D", "week": "W-SUN", "month": "ME", "quarter": "QS-FEB", "hours": "6h", "odd": "fortnight", "none": None}
    groups = {k: pd.date_range("2020-01-05", periods=60, freq=f if k not in ("odd", "none") else "D") for k, f in freqs.items()}
    groups = {k: v[(rng.random(60) < 0.7) | (np.arange(60) % 59 == 0)] for k, v in groups.items()}
    runs = dates.date_runs(frame(spark, groups), "ts", ["k"])
    table = spark.createDataFrame(list(freqs.items()), "k string, freq string")
    got = dates.missing_dates(runs, table).toPandas()
    counts = {r.k: r for r in dates.missing_date_counts(runs, table).collect()}
    for k, v in groups.items():
        if k in ("odd", "none"):
            assert counts[k].missing_count is None and not (got.k == k).any()
            continue
        grid = pd.date_range(v.min(), v.max(), freq=freqs[k])
        assert sorted(got.missing_ts[got.k == k]) == sorted(grid.difference(v))
        assert counts[k].missing_count == len(grid.difference(v)) and counts[k].expected_length == len(grid) and counts[k].frequency == freqs[k]
    match = {r.k: r.expected_match for r in dates.frequency(runs, table).collect()}
    assert match["day"] is True and match["hours"] is not None and match["week"] is None and match["odd"] is None


def test_quotes_and_late_delimiters(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)
    doubled = file("a.csv", 'a,b,c\n"say ""x, y""",1,2\n5" pipe,3,4\n"",5,6\n')
    got = readers.read_delimited(spark, doubled).collect()
    assert [(r.a, r.b, r.c) for r in got] == [('say "x, y"', 1, 2), ('5" pipe', 3, 4), (None, 5, 6)]
    slashed = file("b.csv", 'a,b\n"say \\"x, y\\"",1\n"z",2\n')
    assert [(r.a, r.b) for r in readers.read_delimited(spark, slashed).collect()] == [('say "x, y"', 1), ("z", 2)]
    late = file("c.csv", "".join(f"note {i}\n" for i in range(130)) + "".join(f"{i};{i},5;x\n" for i in range(300)))
    seen = readers.sniff(spark, late)
    assert seen.delimiter == ";" and seen.encoding == "UTF-8"
    (tmp_path / "d.csv").write_bytes("é|1\n".encode("latin-1") * 3)
    assert readers.sniff(spark, str(tmp_path / "d.csv")) == readers.Sniffed("|", "ISO-8859-1", '"')
    empty = file("e.csv", "")
    assert readers.sniff(spark, empty) == readers.Sniffed(",", "UTF-8", '"')
