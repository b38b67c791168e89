"""The tables behind charts: bounded samples, group summaries, thinned series and curves."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import q, to_number
from plumbline.functions.runs import quantiles
from plumbline.functions.series import Series
from plumbline.functions.tables import attach, write_table
from plumbline.operators import breaks, panel
from plumbline.operators.describe import numbers


def hashed_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` random rows. Rows above a hash cut are gone before anything is sorted."""
    n = df.count()
    if n <= rows:
        return df
    u = F.shiftrightunsigned(F.xxhash64("_row", F.lit(seed)), 11) / float(1 << 53)
    few = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_u", u).where(
        F.col("_u") < (2.0 * rows + 200.0) / n)
    return few.orderBy("_u", "_row").limit(rows).drop("_u", "_row")


def scatter_pairs(df: DataFrame, cols: list[str] | None = None, max_pairs: int = 20,
                  max_rows: int = 10_000) -> DataFrame:
    """pair, x_column, y_column, x, y for the first pairs of numeric columns."""
    wide = numbers(df, cols)
    pairs = list(itertools.combinations(wide.columns, 2))[:max_pairs]
    points = [F.struct(F.lit(i).alias("pair"), F.lit(a).alias("x_column"), F.lit(b).alias("y_column"),
                       q(a).alias("x"), q(b).alias("y")) for i, (a, b) in enumerate(pairs)]
    return hashed_sample(wide, max_rows).select(F.inline(F.array(*points)))


def group_means(df: DataFrame, category: str, cols: list[str] | None = None) -> DataFrame:
    """level, column, n, mean, sd: every numeric column by one category."""
    wide = numbers(df, cols)
    names = wide.columns
    rows = df.select(q(category).cast("string").alias("level"), *[to_number(df, c).alias(c) for c in names])
    one = rows.groupBy("level").agg(*[a for i, c in enumerate(names) for a in (
        F.count(q(c)).alias(f"n{i}"), F.avg(q(c)).alias(f"m{i}"), F.stddev_samp(q(c)).alias(f"s{i}"))])
    return one.select("level", F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
        F.col(f"s{i}").alias("sd")) for i, c in enumerate(names)]))).where("level IS NOT NULL")


def box_summary(df: DataFrame, cols: list[str] | None = None, category: str | None = None) -> DataFrame:
    """column, level, q1, median, q3, whisker_low, whisker_high, n, n_outliers."""
    names = numbers(df, cols).columns
    level = q(category).cast("string") if category else F.lit("all")
    long = df.select(level.alias("level"), *[to_number(df, c).alias(c) for c in names]).unpivot(
        ["level"], names, "column", "value").dropna()
    keys = ["column", "level"]
    quart = write_table(quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    # Copies are counted first, and a large (column, level) is spread over pieces for the join.
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "_piece", F.pmod(F.xxhash64("value"), F.lit(256)))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - spread, F.col("q3") + spread)
    return attach(counts, quart, keys, "_piece").groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum("copies").alias("n"),
        F.coalesce(F.sum(F.when(~inside, F.col("copies"))), F.lit(0)).alias("n_outliers"))


def line(df: DataFrame, date: str, value: str) -> DataFrame:
    """ts, mean: repeated dates are averaged."""
    return panel.panel_average(df, date, value)


def thinned(series: Series, cap: int) -> DataFrame:
    """keys, t, ts, y: every (n div cap)-th point of a series longer than ``cap``."""
    step = F.when(F.col("n") > cap, F.floor(F.col("n") / cap)).otherwise(1)
    return series.rows.where(F.col("t") % step == 0).select(*series.keys, "t", "ts", "y")


def chow_curve(series: Series, scan: DataFrame | None = None) -> DataFrame:
    """keys, break_index, f, p_value per candidate."""
    scan = breaks.chow_scan(series) if scan is None else scan
    return scan.select(*series.keys, "candidate", "break_index", "f", "p_value")


def cusum_curve(series: Series, points: int = 500) -> DataFrame:
    """keys, t, cusum, boundary: about ``points`` points of the path."""
    path = breaks.cusum_path(series)
    m = F.col("n") - 3
    step = F.when(m > points, F.floor(m / points)).otherwise(1)
    return path.where((F.col("t") - 3) % step == 0).select(
        *series.keys, "t", "cusum", F.lit(breaks.CUSUM_BOUNDARY).alias("boundary"))


def bic_curve(series: Series, table: DataFrame | None = None) -> DataFrame:
    """keys, n_breaks, bic (4 digits), selected."""
    table = breaks.bai_perron_table(series) if table is None else table
    return table.where("n_breaks IS NOT NULL").select(
        *series.keys, "n_breaks", F.round("bic", 4).alias("bic"), "selected")


def before_after(series: Series) -> DataFrame:
    """keys, break_index, mean_before, mean_after, shift_magnitude."""
    return breaks.mean_shift(series).select(
        *series.keys, "break_index", "mean_before", "mean_after", "shift_magnitude")


def faceted(df: DataFrame, entity: str, date: str, value: str, max_entities: int = 16) -> DataFrame:
    """entity, ts, y of the entities with most rows."""
    rows = panel.rows_of_top_entities(df, entity, max_entities)
    return rows.select(q(entity).cast("string").alias("entity"), q(date).alias("ts"),
                       to_number(df, value).alias("y"))
