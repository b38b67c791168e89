"""Robust seasonal-trend decomposition (STL) and seasonal strength.

Series up to ``GROUP_ROWS`` rows are decomposed one per group. A longer series
is worked block by block: an inner pass only looks a few periods around, so
each block gets that many rows on both sides; between passes the exact median of the
absolute residuals of the whole series sets the robustness weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.lags import key_fields
from plumbline.functions.loess import reach, robust_weights, season_and_trend
from plumbline.functions.runs import quantiles
from plumbline.functions.series import Series, with_halo
from plumbline.functions.tables import attach, write_table

MIN_ROWS = 8
GROUP_ROWS = 1 << 20
OUTER = 15


def _periods(series: Series, period: int | DataFrame) -> DataFrame:
    """keys, n, period, error: one row per series."""
    each = series.one_row_each()
    if isinstance(period, int):
        each = each.withColumn("period", F.lit(period))
    else:
        by = [k for k in series.keys if k in period.columns]
        each = each.join(period.select(*by, F.col("period").cast("int")), by, "left") if by else \
            each.withColumn("period", period.select(F.col("period").cast("int")).limit(1).scalar())
    error = (F.when(F.col("n") < MIN_ROWS, F.lit("Not enough observations for STL decomposition"))
             .when(F.col("period").isNull(), F.lit("Cannot infer STL seasonal period"))
             .when(F.col("period") < 2, F.lit("Seasonal period must be >= 2 for STL")))
    return each.withColumn("error", error)


def stl(series: Series, period: int | DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """keys, t, ts, y, trend, seasonal, resid. ``period``: one number, or a table with key columns and ``period``."""
    keys = series.keys
    table = write_table(_periods(series, period).where("error IS NULL"))
    rows = attach(series.rows.select(*keys, "block", "t", "ts", "n", "y"),
                  table.select(*keys, "period"), keys, "block")
    # The inner pass of a long series reads far around; with few rows per period it is one group anyway.
    fits = (F.col("n") <= group_rows)
    schema = T.StructType([*key_fields(rows, keys)] + [T.StructField(c, k) for c, k in (
        ("t", T.LongType()), ("ts", rows.schema["ts"].dataType), ("y", T.DoubleType()),
        ("trend", T.DoubleType()), ("seasonal", T.DoubleType()), ("resid", T.DoubleType()))])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, p = pdf["y"].to_numpy(float), int(pdf["period"].iloc[0])
        n, trend, weights = len(y), np.zeros(len(y)), None
        for outer in range(OUTER + 1):
            season, trend = season_and_trend(y, trend, weights, p, n)
            if outer < OUTER:
                resid = y - trend - season
                weights = robust_weights(resid, float(np.median(np.abs(resid))))
        out = pdf[[*keys, "t", "ts", "y"]].copy()
        out["trend"], out["seasonal"], out["resid"] = trend, season, y - trend - season
        return out

    small = rows.where(fits).groupBy(*keys).applyInPandas(whole, schema)
    if table.where(~fits).limit(1).count() == 0:
        return small
    return small.unionByName(_blockwise(series, rows.where(~fits)))


def _blockwise(series: Series, rows: DataFrame) -> DataFrame:
    keys = series.keys
    state = write_table(rows.withColumn("trend", F.lit(0.0)).withColumn("w", F.lit(None).cast("double"))
                        .withColumn("seasonal", F.lit(0.0)))
    biggest = state.agg(F.max("period")).first()[0]
    halo_rows = reach(biggest)
    schema = state.schema

    def inner(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        w = pdf["w"].to_numpy(float)
        season, trend = season_and_trend(
            pdf["y"].to_numpy(float), pdf["trend"].to_numpy(float), None if np.isnan(w).all() else w,
            int(pdf["period"].iloc[0]), int(pdf["n"].iloc[0]), int(pdf["t"].iloc[0]))
        out = pdf.assign(trend=trend, seasonal=season)
        return out[pdf["core"]][[f.name for f in schema.fields]]

    resid = F.col("y") - F.col("trend") - F.col("seasonal")
    for outer in range(OUTER + 1):
        halo = with_halo(series, state, halo_rows, halo_rows)
        state = write_table(halo.groupBy(*keys, "block").applyInPandas(inner, schema))
        if outer == OUTER:
            break
        medians = write_table(quantiles(state.select(*keys, F.abs(resid).alias("r")), keys, "r", {"med": 0.5}))
        top, r = 6.0 * F.col("med"), F.abs(resid)
        weight = F.when(r <= 0.001 * top, 1.0).when(
            r <= 0.999 * top, F.pow(1 - F.pow(r / top, F.lit(2)), F.lit(2))).otherwise(0.0)
        state = attach(state, medians, keys, "block").withColumn("w", weight).drop("med")
    return state.select(*keys, "t", "ts", "y", "trend", "seasonal", resid.alias("resid"))


def seasonal_strength(series: Series, period: int | DataFrame, components: DataFrame | None = None) -> DataFrame:
    """keys, period, seasonal_strength (0 to 1, 4 digits), n, error."""
    components = stl(series, period) if components is None else components
    spread = components.groupBy(*series.keys).agg(
        F.var_pop("resid").alias("r"), F.var_pop(F.col("seasonal") + F.col("resid")).alias("sr"))
    strength = F.when(F.col("sr") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("r") / F.col("sr")))
    return _periods(series, period).join(spread, series.keys, "left").select(
        *series.keys, "period", F.when(F.col("error").isNull(), F.round(strength, 4)).alias("seasonal_strength"),
        "n", "error")
