"""Near copies by row codes: what is moved, values of all kinds, rows known from a stricter rule."""

from __future__ import annotations

import datetime as dt
import random
import re
import time
from decimal import Decimal

import pytest
from test_wide import near_by_pairs, plan_of

from plumbline.functions import tables
from plumbline.operators import duplicates, near_rows, row_codes


def test_wide_rows_move_as_codes(spark, monkeypatch, tmp_path):
    # 120 columns of 8 bytes and more went through every exchange, as text once for each of seven parts.
    n = 120
    spark.range(900).selectExpr("id", "id % 30 AS day", *[f"CASE WHEN (id * 11 + {7 * i}) % {n} < id % 3 THEN id % 10 ELSE id % 30 * {i} % {11 + i} END AS c{i}"
                                                           for i in range(n)]).write.parquet(str(tmp_path / "rows"))
    plans = []
    real = near_rows.write_table
    for module in (near_rows, duplicates, tables):
        monkeypatch.setattr(module, "write_table", lambda d: plans.append(plan_of(d)) or real(d))
    flags = duplicates.flag_duplicates(spark.read.parquet(str(tmp_path / "rows")), "id", date="day")
    assert flags.where("rule_b").count() == 900
    plans.append(plan_of(flags))
    moved = [p for p in plans if "Exchange" in p]
    assert moved and not any("c119" in p or "AS values" in p for p in moved)
    assert any("FlatMapGroupsInArrow" in p and "_codes" in p for p in moved)


def shuffle_files(spark):
    """Names of the shuffle files that are there."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in re.findall(r"shuffle_[^,/)]+", found.mkString(",")) if not x.startswith("shuffle_temp")}


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(tables.FILE_CLEANUP)
    written = tables.write_table(spark.range(1000).repartition(3, "id").join(spark.range(500).hint("merge"), "id"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and written.count() == 500 and spark.conf.get(tables.FILE_CLEANUP) == setting


KINDS = {"i": "int", "f": "double", "s": "string", "d": "date", "ts": "timestamp", "nz": "timestamp_ntz", "b": "boolean", "m": "decimal(9,2)", "x": "binary", "a": "array<int>"}


def some_value(kind: str, rng: random.Random):
    k = rng.randint(0, 5)
    return rng.choice([None] + 6 * [{
        "int": k, "double": [0.0, -0.0, float("nan"), 1.5, 2.5, 1e300][k], "string": "x" * k, "date": dt.date(2020, 1, 1 + k),
        "timestamp": dt.datetime(2020, 1, 1, k), "timestamp_ntz": dt.datetime(2020, 1, 1, k), "boolean": k > 2, "decimal(9,2)": Decimal(k) / 4,
        "binary": bytes([255, k]), "array<int>": [k, None] if k else []}[kind]])


def key_of(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return tuple(v) if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("levels", [0, 3, 254])
def test_codes_of_all_kinds(spark, monkeypatch, levels):
    monkeypatch.setattr(row_codes, "LEVELS", levels)
    rng = random.Random(levels)
    rows = []
    for i in range(160):
        one = list(rows[rng.randrange(i)][2:]) if i and rng.random() < 0.7 else [some_value(k, rng) for k in KINDS.values()]
        for at in rng.sample(range(len(one)), rng.choice([0, 1, 2, 4])):
            one[at] = some_value(list(KINDS.values())[at], rng)
        rows.append((i if i % 9 else None, rng.choice(["d0", "d0", None]), *one))
    df = spark.createDataFrame(rows, "id long, day string, " + ", ".join(f"{c} {t}" for c, t in KINDS.items()))
    numbered = [(i, ((r[1],), [key_of(v) for v in r[2:]])) for i, r in enumerate(rows)]
    near = near_by_pairs([r for _, r in numbered], 1, 2)
    same = near_by_pairs([r for _, r in numbered], 1, 0)
    got = duplicates.flag_duplicates(df, "id", date="day", threshold=0.8).collect()
    count = lambda hits: sorted((str(rows[i][0]) for i in hits))
    assert len(got) == len(rows)
    assert sorted(str(r.id) for r in got if r.rule_b) == count(near) and sorted(str(r.id) for r in got if r.rule_a) == count(same)
    assert 0 < len(same) < len(near) < len(rows)


@pytest.mark.parametrize("bucket", [4, 512])
def test_rules_share_what_is_known(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_rows, "BUCKET_ROWS", bucket)
    rng = random.Random(7)
    rows = []
    for i in range(300):
        one = list(rows[-1][3:]) if i % 4 else [str(rng.randint(0, 400)) for _ in range(41)]
        for at in rng.sample(range(41), rng.choice([0, 1, 2, 3])):
            one[at] = str(rng.randint(0, 400))
        rows.append((i, f"d{i // 150}", rng.choice(["e0", "e1", None]), *one))
    df = spark.createDataFrame(rows, "id long, day string, entity string, " + ", ".join(f"c{i} string" for i in range(41)))
    got = duplicates.flag_duplicates(df, "id", "entity", "day").collect()
    by_date = near_by_pairs([((r[1],), r[2:]) for r in rows], 1, duplicates.allowed_mismatches(42, 0.95))
    by_both = near_by_pairs([((r[1], r[2]), r[3:]) for r in rows], 2, duplicates.allowed_mismatches(41, 0.95))
    assert {r.id for r in got if r.rule_b} == by_date and {r.id for r in got if r.rule_c} == by_both
    assert 0 < len(by_both) < len(by_date) < 300
