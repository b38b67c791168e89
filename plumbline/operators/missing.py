"""Missing values. One aggregate pass per question, nothing is shuffled but totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nulls_for_nan, q

# The row bands, upper bounds in percent of empty columns.
BANDS = ["complete (0%)", "low (0-10%)", "moderate (10-50%)", "high (50-90%)", "mostly empty (>90%)"]


def _is_missing(name: str) -> Column:
    return q(name).isNull().cast("int")


def _row_missing(df: DataFrame) -> Column:
    total = F.lit(0)
    for c in df.columns:
        total = total + _is_missing(c)
    return total


def _counts(df: DataFrame) -> DataFrame:
    """column, dtype, n_missing, n_rows, position: one row per column from one aggregate row."""
    df = nulls_for_nan(df)
    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(q(c)).alias(f"filled_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.lit(i).alias("position"),
                 (F.col("n_rows") - F.col(f"filled_{i}")).alias("n_missing"))
        for i, c in enumerate(df.columns)])
    return one.select("n_rows", F.explode(cells).alias("cell")).select(
        "cell.column", "cell.dtype", "cell.n_missing", "n_rows", "cell.position")


def missing_columns(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """column, dtype, n_missing, pct (2 digits), most missing first."""
    out = _counts(df).withColumn("pct", F.round(F.try_divide("n_missing", "n_rows") * 100, 2))
    if only_missing:
        out = out.where("n_missing > 0")
    return out.orderBy(F.desc("n_missing"), "position").select("column", "dtype", "n_missing", "pct")


def populated_columns(df: DataFrame) -> DataFrame:
    """column: those without a single missing value, in table order."""
    return _counts(df).where("n_missing = 0").orderBy("position").select("column")


def missing_by_type(df: DataFrame) -> DataFrame:
    """dtype, n_columns, n_missing."""
    return _counts(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"),
                                            F.sum("n_missing").alias("n_missing"))


def missing_total(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells and complete rows with their percentages."""
    df = nulls_for_nan(df)
    width = len(df.columns)
    one = df.select(_row_missing(df).alias("m")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("total_missing"),
        F.count_if(F.col("m") == 0).alias("complete_rows"))
    cells = F.col("n_rows") * width
    return one.select(
        "n_rows", F.lit(width).alias("n_columns"), cells.alias("total_cells"), "total_missing",
        F.coalesce(F.round(F.try_divide(F.col("total_missing"), cells) * 100, 4), F.lit(0.0))
        .alias("missing_percentage"),
        "complete_rows",
        F.coalesce(F.round(F.try_divide("complete_rows", "n_rows") * 100, 2), F.lit(0.0))
        .alias("complete_row_percentage"))


def missing_bands(df: DataFrame) -> DataFrame:
    """band, n_rows: rows by share of empty columns; empty bands are kept."""
    df = nulls_for_nan(df)
    pct = F.col("m") / F.lit(len(df.columns)) * 100
    hits = [F.col("m") == 0, (F.col("m") > 0) & (pct <= 10), (pct > 10) & (pct <= 50),
            (pct > 50) & (pct <= 90), pct > 90]
    one = df.select(_row_missing(df).alias("m")).agg(
        *[F.count_if(h).alias(f"b{i}") for i, h in enumerate(hits)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"b{i}").alias("n_rows"))
        for i, b in enumerate(BANDS)])).alias("r")).select("r.band", "r.n_rows")
