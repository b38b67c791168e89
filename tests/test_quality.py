"""Missing values, duplicates and roles on planted tables."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, missing, roles


@pytest.fixture(scope="module")
def holes(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0, "x")] * 2 + [(None, "a", nan, None), (None, None, None, None), (2, None, 3.0, "y")]
    return spark.createDataFrame(rows, "i int, s string, d double, z string")


def test_nan_and_null_are_both_missing(holes):
    got = {r["column"]: r["n_missing"] for r in missing.missing_columns(holes).collect()}
    assert got == {"i": 2, "s": 2, "d": 2, "z": 2}
    one = missing.missing_total(holes).first()
    assert (one.total_cells, one.total_missing, one.complete_rows) == (20, 8, 2)
    assert one.missing_percentage == 40.0 and one.complete_row_percentage == 40.0


def test_bands_keep_empty_ones(holes):
    got = [r.n_rows for r in missing.missing_bands(holes).collect()]
    assert got == [2, 0, 1, 1, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, a int, b string")
    one = missing.missing_total(df).first()
    assert one.total_cells == 0 and one.missing_percentage == 0.0 and one.complete_row_percentage == 0.0
    rates = duplicates.duplicate_rates(duplicates.flag_duplicates(df, "id")).first()
    assert rates.duplicate_count == 0 and rates.duplicate_percentage == 0.0


def wide_rows(n_cols=21, seed=3):
    """Rows on few dates: exact copies, pairs one and two columns apart, equal nulls."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (12, n_cols)).astype(object)
    rows = []
    for b in base:
        rows.append(b.copy())
        for flips in (0, 1, 2):
            r = b.copy()
            for j in rng.choice(n_cols, flips, replace=False):
                r[j] = 9
            if rng.random() < 0.7:
                rows.append(r)
    for r in rows:
        if rng.random() < 0.3:
            r[0] = None
    days = rng.integers(1, 4, len(rows))
    return [(i, f"2024-01-0{d}", *[None if v is None else str(v) for v in r])
            for i, (d, r) in enumerate(zip(days, rows, strict=True))]


@pytest.mark.parametrize("n_cols, threshold", [(21, 0.95), (8, 0.75), (5, 0.95)])
def test_near_duplicates_match_all_pairs(spark, n_cols, threshold):
    rows = wide_rows(n_cols)
    names = [f"c{i}" for i in range(n_cols)]
    df = spark.createDataFrame(rows, "id long, day string, " + ", ".join(f"{c} string" for c in names))
    got = {r.id: r for r in duplicates.flag_duplicates(df, "id", "c1", "day", threshold).collect()}
    flags = {"rule_a": set(), "rule_b": set(), "rule_c": set()}
    for a, b in itertools.combinations(rows, 2):
        same = sum(x == y for x, y in zip(a[2:], b[2:], strict=True))
        if a[1:] == b[1:]:
            flags["rule_a"] |= {a[0], b[0]}
        if a[1] == b[1] and same >= int(np.ceil(n_cols * threshold)):
            flags["rule_b"] |= {a[0], b[0]}
        rest = sum(x == y for i, (x, y) in enumerate(zip(a[2:], b[2:], strict=True)) if i != 1)
        if a[1] == b[1] and a[3] == b[3] and rest >= int(np.ceil((n_cols - 1) * threshold)):
            flags["rule_c"] |= {a[0], b[0]}
    for rule, ids in flags.items():
        assert {i for i, r in got.items() if r[rule]} == ids, rule
    assert len(got) == len(rows)


def test_groups_and_sample(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 2 else "x") for i in range(12)] + [(99, 7, "q")],
                               "id long, a int, b string")
    groups = duplicates.first_groups(df, "id").collect()
    assert [g.group_id for g in groups] == [0, 1, 2, 3, 4, 5] and {g.copies for g in groups} == {2}
    members = duplicates.group_members(df, "id").collect()
    assert sorted((m.group_id, m.id) for m in members) == sorted((i % 6, i) for i in range(12))
    flags = duplicates.flag_duplicates(df, "id")
    sample = duplicates.duplicate_sample(df, flags, "id", limit=5).collect()
    assert [r.id for r in sample] == [0, 1, 2, 3, 4] and all(r.truncated for r in sample)


def test_key_only_table(spark):
    df = spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2"), (4, None), (5, None)], "id long, day string")
    got = duplicates.flag_duplicates(df, "id", date="day").where("rule_b").select("id").collect()
    assert sorted(r.id for r in got) == [1, 2, 4, 5]
    assert sorted(r.id for r in duplicates.key_duplicates(df, "id", ["day"]).collect()) == [1, 2, 4, 5]


def test_date_detection_paths(spark):
    rows = [(f"2024-01-{i + 1:02d}", "5%", "2024-02-03" if i < 4 else "text", 2000 + i, "word", None) for i in range(10)]
    df = spark.createDataFrame(rows, "plain string, share string, my_date string, year int, txt string, empty string")
    got = {r["column"]: r for r in roles.detect_dates(df).collect()}
    assert got["plain"].is_date and got["plain"].parse_ratio == 1.0
    assert not got["share"].is_date and got["share"].reason
    assert got["my_date"].is_date and got["my_date"].parse_ratio == 0.4      # name counts above 0.3
    assert "year" not in got and not got["txt"].is_date and not got["empty"].is_date
    assert roles.choose_date(roles.detect_dates(df)) == "plain"
    assert roles.choose_date(roles.detect_dates(df), "my_date") == "my_date"


def test_codes_and_one_hot(spark):
    pdf = pd.DataFrame({"id": range(6), "c": ["b", "a", None, "b", "é", "a"]})
    df = spark.createDataFrame(pdf)
    codes = {r.id: r.c_code for r in roles.integer_codes(df, ["c"], ["id"]).collect()}
    assert codes == {0: 1, 1: 0, 2: -1, 3: 1, 4: 2, 5: 0}
    hot = roles.one_hot(df, ["c"], ["id"]).orderBy("id").toPandas()
    assert hot[["c_a", "c_b", "c_é"]].sum(axis=1).tolist() == [1, 1, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        roles.one_hot(df, ["c"], ["id"], max_levels=2)


@pytest.mark.parametrize("dates, cats, kind", [
    ([], ["c"], "cross_sectional"), (["ts", "x"], [], "unknown"), (["ts"], ["c"], "panel"), (["ts"], [], "unknown"),
    (["u"], [], "time_series")])
def test_dataset_types(spark, dates, cats, kind):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01", "p"), ("2024-01-01", "2024-01-02", "q")],
                               "ts string, u string, c string").withColumn("x", F.col("ts"))
    assert roles.classify(df, dates, cats).first().dataset_type == kind
