"""Panels: ranges, balance, variance shares, frequency consistency, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nulls_for_nan, q, to_moment, to_number
from plumbline.functions.series import Series, build_series
from plumbline.operators import dates


def panel_ranges(df: DataFrame, entity: str, date: str) -> DataFrame:
    """entity, level, start, end, n: every entity and the whole panel from one rollup."""
    rows = df.select(q(entity).cast("string").alias("entity"), to_moment(df, date).alias("ts")).dropna()
    return rows.rollup("entity").agg(
        F.when(F.grouping("entity") == 1, "panel").otherwise("entity").alias("level"),
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("ts").alias("n"))


def balance(df: DataFrame, entity: str, date: str) -> DataFrame:
    """One row: entities, periods, expected and actual pairs, balance ratio (4 digits)."""
    df = nulls_for_nan(df)
    pairs = df.select(q(entity).alias("e"), q(date).alias("d")).groupBy("e", "d").agg(
        F.count(F.lit(1)).alias("_n"))
    both = F.col("e").isNotNull() & F.col("d").isNotNull()
    one = pairs.agg(F.countDistinct("e").alias("n_entities"), F.countDistinct("d").alias("n_time_periods"),
                    F.count_if(both).alias("actual_obs"))
    expected = F.col("n_entities") * F.col("n_time_periods")
    return one.select(
        "n_entities", "n_time_periods", expected.alias("expected_obs"), "actual_obs",
        (F.col("actual_obs") == expected).alias("is_balanced"),
        (expected - F.col("actual_obs")).alias("missing_combinations"),
        F.coalesce(F.round(F.try_divide("actual_obs", expected), 4), F.lit(0.0)).alias("balance_ratio"))


def variance_decomposition(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """column, overall, between and within variance (6 digits) and their shares in percent (2 digits).

    Between: variance of the entity means; within: mean of the entity variances.
    Columns with fewer than two entities or no variance are left out.
    """
    wide = df.select(q(entity).alias("_entity"), *[to_number(df, c).alias(c) for c in cols])
    long = wide.unpivot(["_entity"], cols, "column", "value").dropna()
    per_entity = long.groupBy("column", "_entity").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    overall = long.groupBy("column").agg(F.var_samp("value").alias("o"))
    parts = per_entity.groupBy("column").agg(
        F.count(F.lit(1)).alias("entities"), F.var_samp("m").alias("b"), F.avg("v").alias("w"))
    # One row per column of the input on both sides.
    out = parts.join(F.broadcast(overall), "column").where("entities >= 2 AND o > 0")
    return out.select(
        "column", F.round("o", 6).alias("overall_variance"), F.round("b", 6).alias("between_variance"),
        F.round("w", 6).alias("within_variance"),
        F.round(F.col("b") / F.col("o") * 100, 2).alias("between_pct"),
        F.round(F.col("w") / F.col("o") * 100, 2).alias("within_pct"))


def panel_frequency(df: DataFrame, entity: str, date: str, runs: dates.DateRuns | None = None) -> DataFrame:
    """entity, n_observations, most_common, median_days, is_regular, dominant, matches.

    ``dominant`` is the most frequent of the entities' most common deltas, the
    smallest on ties; an entity without deltas does not match.
    """
    runs = runs or dates.date_runs(df, date, [entity])
    each = dates.frequency(runs)
    votes = each.where("most_common IS NOT NULL").groupBy("most_common").agg(F.count(F.lit(1)).alias("n"))
    dominant = votes.agg(F.max_by("most_common", F.struct("n", -F.col("most_common"))).alias("dominant"))
    out = each.withColumn("dominant", dominant.scalar())
    same = F.col("most_common").eqNullSafe(F.col("dominant"))
    return out.select(entity, "n_observations", "most_common", "median_days", "is_regular", "dominant",
                      same.alias("matches"))


def panel_consistency(frequencies: DataFrame) -> DataFrame:
    """One row: dominant delta, matching and mismatching entities, consistent."""
    return frequencies.agg(
        F.max("dominant").alias("dominant"), F.count_if("matches").alias("n_matching"),
        F.count_if(~F.col("matches")).alias("n_mismatching"),
        F.bool_and("matches").alias("consistent"))


def panel_average(df: DataFrame, date: str, value: str) -> DataFrame:
    """ts, mean: mean of the value per date."""
    rows = df.select(to_moment(df, date).alias("ts"), to_number(df, value).alias("v")).where("ts IS NOT NULL")
    return rows.groupBy("ts").agg(F.avg("v").alias("mean"))


def snapshot(df: DataFrame, entity: str, date: str, value: str, at=None, max_entities: int = 30) -> DataFrame:
    """entity, ts, value at one date (default: the last); the largest values when there are more."""
    rows = df.select(q(entity).alias("entity"), to_moment(df, date).alias("ts"), to_number(df, value).alias("value"))
    # Neither date passes through the driver's time zone.
    day = rows.agg(F.max("ts")).scalar() if at is None else F.lit(str(at)).cast("timestamp_ntz")
    return rows.where(F.col("ts") == day).orderBy(
        F.desc_nulls_last("value"), "entity").limit(max_entities)


def top_entities(df: DataFrame, entity: str, max_entities: int = 20) -> DataFrame:
    """entity, n: the entities with most rows, by name on ties."""
    return df.where(q(entity).isNotNull()).groupBy(q(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(max_entities)


def rows_of_top_entities(df: DataFrame, entity: str, max_entities: int = 20) -> DataFrame:
    """Rows of the entities with most rows; their list has at most ``max_entities`` rows, so it is broadcast."""
    top = top_entities(df, entity, max_entities).select(F.col("entity").alias(entity))
    return df.join(F.broadcast(top), entity, "left_semi")


def entity_series(df: DataFrame, entity: str, date: str, values: list[str], **options) -> Series:
    """Every entity and numeric column as its own series: the input of all time-series operators."""
    return build_series(df, date, values, [entity], **options)


