"""Descriptive statistics per numeric column, outliers, correlation and Jarque-Bera."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (MOMENTS, columns_of, nulls_for_nan, numeric_columns, q,
                                         to_number)
from plumbline.functions.quantiles import wide_quantiles
from plumbline.functions.runs import ranked_runs
from plumbline.functions.tables import lookup, write_table


def _long(one: DataFrame, cells: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return one.select(F.inline(F.array(*cells)))


def numbers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The chosen (default: all numeric) columns as doubles without NaN."""
    cols = cols or numeric_columns(df)
    return df.select(*[to_number(df, c).alias(c) for c in cols])


def long_numbers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, value: one row per non-missing cell."""
    wide = numbers(df, cols)
    return wide.unpivot([], wide.columns, "column", "value").where("value IS NOT NULL")


def min_max(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, min, max as text, for numeric, boolean and date columns."""
    df = nulls_for_nan(df)
    cols = cols or [c for c in df.columns
                    if c in set(numeric_columns(df)) | set(columns_of(df, (T.BooleanType, *MOMENTS)))]
    one = df.agg(*[F.min(q(c)).alias(f"lo_{i}") for i, c in enumerate(cols)],
                 *[F.max(q(c)).alias(f"hi_{i}") for i, c in enumerate(cols)])
    return _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"lo_{i}").cast("string").alias("min"),
                                F.col(f"hi_{i}").cast("string").alias("max"))
                       for i, c in enumerate(cols)])


def numeric_range(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, min, max as doubles, for numeric columns."""
    wide = numbers(df, cols)
    one = wide.agg(*[F.min(q(c)).alias(f"lo_{i}") for i, c in enumerate(wide.columns)],
                   *[F.max(q(c)).alias(f"hi_{i}") for i, c in enumerate(wide.columns)])
    return _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"lo_{i}").alias("min"),
                                F.col(f"hi_{i}").alias("max")) for i, c in enumerate(wide.columns)])


def _moments(wide: DataFrame) -> DataFrame:
    """column, n, mean, std, pop_std, g1, g2 from one pass."""
    aggs, cells = [], []
    for i, c in enumerate(wide.columns):
        x = q(c)
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"),
                 F.stddev_samp(x).alias(f"s_{i}"), F.stddev_pop(x).alias(f"p_{i}"),
                 F.skewness(x).alias(f"g_{i}"), F.kurtosis(x).alias(f"k_{i}")]
        cells.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("mean"),
            F.col(f"s_{i}").alias("std"), F.col(f"p_{i}").alias("pop_std"),
            F.col(f"g_{i}").alias("g1"), F.col(f"k_{i}").alias("g2")))
    return _long(wide.agg(*aggs), cells)


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, n, mean, std, skewness, kurtosis (bias-corrected, excess)."""
    n = F.col("n").cast("double")
    skew = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6))
    # A constant column has no spread to skew.
    flat = F.col("pop_std") == 0
    return _moments(numbers(df, cols)).select(
        "column", "n", "mean", F.when(n >= 2, F.col("std")).alias("std"),
        F.when(flat & (n >= 3), F.lit(0.0)).otherwise(skew).alias("skewness"),
        F.when(flat & (n >= 4), F.lit(0.0)).otherwise(kurt).alias("kurtosis"))


def _small_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row per column of the input, known on the driver."""
    return df.sparkSession.createDataFrame(rows, schema)


def medians(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, median: exact at any size, without moving rows."""
    found = wide_quantiles(numbers(df, cols), {"median": 0.5})
    return _small_table(df, [(c, v["median"]) for c, v in found.items()], "`column` string, median double")


def iqr_fences(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """column, q1, q3, lower, upper."""
    rows = []
    for c, v in wide_quantiles(numbers(df, cols), {"q1": 0.25, "q3": 0.75}).items():
        spread = v["q3"] - v["q1"]
        rows.append((c, v["q1"], v["q3"], v["q1"] - k * spread, v["q3"] + k * spread))
    return _small_table(df, rows, "`column` string, q1 double, q3 double, lower double, upper double")


def z_fences(df: DataFrame, cols: list[str] | None = None, k: float = 3.0) -> DataFrame:
    """column, mean, pop_std: an outlier is further than ``k`` population deviations away."""
    return _moments(numbers(df, cols)).select("column", "mean", "pop_std", F.lit(float(k)).alias("k"))


def _fences(df: DataFrame, cols: list[str] | None, method: str, k: float | None) -> DataFrame:
    if method == "iqr":
        return iqr_fences(df, cols, 1.5 if k is None else k)
    if method == "zscore":
        return z_fences(df, cols, 3.0 if k is None else k)
    raise ValueError(f"unknown outlier method: {method}")


def _distance(method: str, fence, x: Column) -> Column:
    """How far a value is beyond its column's fence; null for values within."""
    if method == "iqr":
        return F.when(x < fence["lower"], fence["lower"] - x).when(x > fence["upper"], x - fence["upper"])
    z = F.abs((x - fence["mean"]) / F.lit(fence["pop_std"] or None))
    return F.when(z > fence["k"], z - fence["k"])


def outliers(df: DataFrame, cols: list[str] | None = None, method: str = "iqr",
             k: float | None = None) -> DataFrame:
    """Fences and the exact number of outliers per column, counted on the wide rows in one pass."""
    fences = _fences(df, cols, method, k)
    known = {r["column"]: r for r in fences.collect()}
    wide = numbers(df, cols)
    names = [c for c in wide.columns if c in known]
    one = wide.agg(F.count(F.lit(1)).alias("rows"), *[a for i, c in enumerate(names) for a in (
        F.count(q(c)).alias(f"n{i}"), F.count(_distance(method, known[c], q(c))).alias(f"o{i}"))])
    if not names:
        return fences.withColumns({"n": F.lit(0).cast("long"), "n_outliers": F.lit(0).cast("long")})
    counts = _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("n_outliers"))
                         for i, c in enumerate(names)]).where("n > 0")
    return fences.join(F.broadcast(counts), "column")


def outlier_values(df: DataFrame, cols: list[str] | None = None, method: str = "iqr",
                   k: float | None = None, limit: int | None = None) -> DataFrame:
    """column, value, distance, rank, n_outliers, sample_capped: the outliers of every column, the furthest out first.

    ``distance`` is how far a value is beyond its fence, low or high, and ``rank`` counts the values further out, plus
    one. Without ``limit`` all outliers come. With it, tasks pass on the ``limit`` furthest of each column only, the
    smaller value first on ties; ``n_outliers`` still counts all, and ``sample_capped`` tells that some are left out.
    """
    counted = outliers(df, cols, method, k)
    known = {r["column"]: r for r in counted.collect()}
    wide = numbers(df, cols)
    far = F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("value"), _distance(method, known[c], q(c)).alias("distance"))
                    for c in wide.columns if c in known])
    found = wide.select(F.explode(F.filter(far, lambda x: x["distance"].isNotNull())).alias("x")).select("x.*")
    if limit is None:
        # Ranks over sorted runs, so that no column meets in one task.
        runs = ranked_runs(found.withColumn("nearness", -F.col("distance")), ["column"], ["nearness", "value"])
        first = write_table(runs.select("column", "nearness", "value", "copies", "start"))
        ties = ranked_runs(found.select("column", (-F.col("distance")).alias("nearness")), ["column"], ["nearness"]).select(
            "column", "nearness", (F.col("start") + 1).alias("rank"))
        out = first.join(ties, ["column", "nearness"]).select(
            "column", "value", (-F.col("nearness")).alias("distance"), "rank", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    else:
        order = W.partitionBy("column").orderBy(F.desc("distance"), "value")
        out = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).withColumn(
            "rank", F.rank().over(W.partitionBy("column").orderBy(F.desc("distance"))).cast("long"))
    sizes = counted.select("column", "n_outliers")
    return out.join(F.broadcast(sizes), "column").select(
        "column", "value", "distance", "rank", "n_outliers",
        (F.col("n_outliers") > limit if limit is not None else F.lit(False)).alias("sample_capped"))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """The chosen columns as doubles, without rows that miss any of them."""
    return numbers(df, cols).dropna()


def correlation(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """col_a, col_b, r (4 digits), n_used, error: every pair of columns over complete rows."""
    cols = cols or numeric_columns(df)
    wide = complete_cases(df, cols)
    if method == "spearman":
        wide = _rank_rows(wide)
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    one = wide.agg(F.count(F.lit(1)).alias("n"),
                   *[F.corr(q(cols[i]), q(cols[j])).alias(f"r_{i}_{j}") for i, j in pairs if i != j],
                   *[F.stddev_pop(q(c)).alias(f"s_{i}") for i, c in enumerate(cols)])
    few = "Need at least 2 numeric columns" if len(cols) < 2 else None
    error = F.when(F.lit(few).isNotNull(), F.lit(few)).when(
        F.col("n") < 3, F.lit("Not enough complete rows"))
    cells = []
    for i, j in itertools.product(range(len(cols)), repeat=2):
        a, b = min(i, j), max(i, j)
        r = F.when(F.col(f"s_{i}") > 0, F.lit(1.0)) if i == j else F.col(f"r_{a}_{b}")
        cells.append(F.struct(
            F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
            F.when(error.isNull(), F.round(r, 4) + 0.0).alias("r"), F.col("n").alias("n_used"),
            error.alias("error")))
    return _long(one, cells)


# Rank tables of together at most so many rows (24 bytes each) are sent to every task; larger ones are joined by shuffle.
SENT_RANKS = 1 << 20


def _rank_rows(wide: DataFrame) -> DataFrame:
    """Replace every value by its average rank in its column.

    Ranks come from the sorted distinct values, which tasks count before anything is exchanged. Each column's table of
    ranks is looked up on the wide rows: those with few distinct values are sent to the tasks, so that the rows stay where
    they are; the rows are exchanged only for columns with very many distinct values, whose frequent ones are sent too.
    """
    # Names of our own, which cannot clash with what is looked up.
    names = [f"v{i}" for i in range(len(wide.columns))]
    rows, room = wide.toDF(*names), SENT_RANKS
    runs = ranked_runs(rows.unpivot([], names, "column", "value"), ["column"], ["value"])
    ranks = write_table(runs.select("column", "value", "copies", (F.col("start") + (F.col("copies") + 1) / 2.0).alias("rank")))
    # A row per column.
    sizes = {r[0]: r[1] for r in ranks.groupBy("column").agg(F.count(F.lit(1))).collect()}
    for c in sorted(names, key=lambda x: sizes.get(x, 0)):
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(c), "copies", "rank")
        room -= sizes.get(c, 0)
        if room >= 0:
            rows = rows.join(F.broadcast(own.drop("copies")), c)
        else:
            rows = lookup(rows, own, [c], "copies", ["rank"])
        rows = rows.select(*[x for x in rows.columns if x not in (c, "rank")], F.col("rank").alias(c))
    return rows.select(*names).toDF(*wide.columns)


def jarque_bera(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, n_used, statistic, p_value, is_normal, error."""
    n = F.col("n").cast("double")
    stat = n / 6 * (F.pow("g1", F.lit(2)) + F.pow("g2", F.lit(2)) / 4)
    return _moments(numbers(df, cols)).select(
        "column", F.lit("jarque_bera").alias("test"), F.col("n").alias("n_used"),
        F.when(n >= 3, stat).alias("statistic")
    ).withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn(
        "is_normal", F.col("p_value") >= 0.05).withColumn(
        "error", F.when(F.col("n_used") < 3, F.lit("too few observations")))
