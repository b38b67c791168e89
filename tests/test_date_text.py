"""Dates in text by whole columns: odd values, and how Spark reads them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from test_wide import plan_of

from plumbline.functions.date_text import date_of, readings

ODD = [("2020-03-07\n", dt.datetime(2020, 3, 7)), ("2020-03/07", None), ("31/12/2020", None), ("٣/٣/2020", None), ("2020-03-07 10:20:60", dt.datetime(2020, 3, 7, 10, 21)),
       ("2020-03-07 10:20:60.5", None), ("TUES., 7 Octo 99", dt.datetime(1999, 10, 7)), ("7-Mar-2020 12:05 AM +0130", dt.datetime(2020, 3, 6, 22, 35)),
       ("20200307T10:20", dt.datetime(2020, 3, 7, 10, 20)), ("2020-03 10:20", None), ("21st September., 2020 at  10:20:30.123456789 am +05:30", None)]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ODD)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", date_of(F.col("t")).alias("d")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(ODD)] == ODD
    assert df.where("i < 0").select(date_of(F.col("t"), True)).count() == 0


def test_texts_are_read_by_columns(spark):
    # Row by row, text went through some twenty patterns in code too large to be compiled.
    df = spark.createDataFrame([("1/2/2020", "?", None)] * 20, "a string, b string, c string")
    read = readings(df, {c: F.col(c) for c in df.columns}, {})
    assert plan_of(read).count("ArrowEvalPython") == 1 and "lambdafunction" not in plan_of(read) and "regexp" not in plan_of(read).lower()
    one = read.first()
    assert (one.a.shape, one.a.month_first, one.a.day_first, one.a.one, one.a.two) == ("n-n-y", dt.datetime(2020, 1, 2), dt.datetime(2020, 2, 1), 1, 2)
    assert one.b.shape is None and one.c.shape is None
