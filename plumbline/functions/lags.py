"""Lag products of a series: sums of a(t) * b(t - k) for k = 0 .. max lag.

Blocks get the rows before them as a halo, so every product is formed inside
one block of bounded size and only one row per (series, lag) is left per block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.series import Series, with_halo


def long_lag(n: Column) -> Column:
    """Lag bound 12 (n / 100)^(1/4), rounded up."""
    return F.ceil(12.0 * F.pow(n / F.lit(100.0), F.lit(0.25))).cast("int")


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def lagged(series: Series, rows: DataFrame, value: Column, lags: int, prefix: str = "lag") -> DataFrame:
    """Core rows with ``lag1 .. lagK`` of the value, inside the JVM; for a fixed small K."""
    halo = with_halo(series, rows.withColumn("_v", value), lags)
    inside = W.partitionBy(*series.keys, "block").orderBy("t")
    return halo.select("*", *[F.lag("_v", k).over(inside).alias(f"{prefix}{k}")
                              for k in range(1, lags + 1)]).where("core")


def lag_products(series: Series, halo: DataFrame, pairs: list[tuple[str, str]], max_lag: str) -> DataFrame:
    """keys, lag, p0, p1, ...: one product sum per pair of columns of a haloed table.

    The halo must reach back at least ``max_lag`` rows. Numpy works on one block
    at a time, which holds a bounded number of rows.
    """
    keys = series.keys
    schema = T.StructType([*key_fields(halo, keys), T.StructField("lag", T.IntegerType()),
                           *[T.StructField(f"p{i}", T.DoubleType()) for i in range(len(pairs))]])
    names = sorted({c for pair in pairs for c in pair})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        core = int(np.argmax(pdf["core"].to_numpy()))
        top = int(pdf[max_lag].iloc[0])
        size = len(pdf)
        col = {c: pdf[c].to_numpy(float) for c in names}
        out = {k: [v] * (top + 1) for k, v in zip(keys, key, strict=False)}
        out["lag"] = np.arange(top + 1, dtype="int32")
        for i, (a, b) in enumerate(pairs):
            sums = np.zeros(top + 1)
            for k in range(top + 1):
                lo = max(core, k)
                sums[k] = col[a][lo:] @ col[b][lo - k:size - k] if lo < size else 0.0
            out[f"p{i}"] = sums
        return pd.DataFrame(out)

    slim = halo.select(*keys, "block", "t", "core", max_lag, *names)
    parts = slim.groupBy(*keys, "block").applyInPandas(block, schema)
    return parts.groupBy(*keys, "lag").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(pairs))])


def lag_arrays(products: DataFrame, keys: list[str], n_pairs: int) -> DataFrame:
    """keys, p0 array, p1 array, ... ordered by lag (max lag + 1 entries)."""
    packed = products.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("lag", *[f"p{i}" for i in range(n_pairs)]))).alias("_a"))
    return packed.select(*keys, *[F.col(f"_a.p{i}").alias(f"p{i}") for i in range(n_pairs)])
