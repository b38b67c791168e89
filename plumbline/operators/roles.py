"""Column roles: date detection, category levels and encodings, kind of dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import MOMENTS, columns_of, q, string_columns, to_moment, type_of
from plumbline.functions.date_text import EITHER, SHAPES, readings
from plumbline.functions.tables import lookup, write_table, write_wide

# Words that make a column name look like a date.
DATE_WORDS = ["date", "time", "year", "month", "day", "period", "timestamp"]

def name_score(name: str) -> int:
    return sum(word in name.lower() for word in DATE_WORDS)


def detect_dates(df: DataFrame, formats: list[str] | None = None, threshold: float = 0.8,
                 cols: list[str] | None = None) -> DataFrame:
    """column, position, name_score, parse_ratio, best_format, day_first, is_date, reason in one pass.

    Text and date columns are candidates; numbers are not dates unless they are
    named in ``cols``. Every text column is counted by the shapes of dates that
    its values have and parse as; where day and month could be swapped, the
    column's largest numbers settle their order (month first if they don't).
    ``formats`` are tried besides. A text column that contains ``%`` is ruled out.
    """
    names = cols or [c for c in df.columns if c in set(columns_of(df, (T.StringType, *MOMENTS)))]
    aggs, cells, read, texts = [F.count(F.lit(1)).alias("n")], [], {}, {}
    for i, c in enumerate(names):
        cell = [F.lit(c).alias("column"), F.lit(df.columns.index(c)).alias("position"), F.lit(name_score(c)).alias("name_score")]
        if isinstance(type_of(df, c), MOMENTS):
            read[f"m_{i}"] = q(c)
            aggs.append(F.count(f"m_{i}").alias(f"h_{i}"))
            cells.append(F.struct(*cell, F.lit(False).alias("veto"), F.col(f"h_{i}").alias("hits"),
                                  F.lit(None).cast("string").alias("best_format"), F.lit(False).alias("day_first")))
            continue
        texts[f"r_{i}"] = q(c).cast("string")
        for k, f in enumerate(formats or []):
            read[f"g_{i}_{k}"] = F.try_to_timestamp(q(c).cast("string"), F.lit(f)).isNotNull()
        read[f"p_{i}"] = F.contains(q(c).cast("string"), F.lit("%"))
        # A value counts for the first format that reads it.
        counted, free = {}, F.lit(True)
        for k, f in enumerate(formats or []):
            hit = F.coalesce(F.col(f"g_{i}_{k}"), F.lit(False))
            counted[f] = free & hit
            free = free & ~hit
        shape, american, european = (F.col(f"r_{i}.{x}") for x in ("shape", "month_first", "day_first"))
        for s in SHAPES:
            if s != EITHER:
                counted[s] = free & (shape == s) & american.isNotNull()
        orders = {"m-d-y": free & (shape == EITHER) & american.isNotNull(), "d-m-y": free & (shape == EITHER) & european.isNotNull()}
        aggs += [F.count_if(hit).alias(f"h_{i}_{k}") for k, hit in enumerate([*counted.values(), *orders.values()])]
        aggs += [F.max(f"r_{i}.one").alias(f"f_{i}"), F.max(f"r_{i}.two").alias(f"s_{i}"), F.max(f"p_{i}").alias(f"v_{i}")]
        swapped = F.coalesce((F.col(f"f_{i}") > 12) & (F.col(f"s_{i}") <= 12), F.lit(False))
        hits = {f: F.col(f"h_{i}_{k}") for k, f in enumerate([*counted, *orders])}
        hits["m-d-y"] = F.when(swapped, 0).otherwise(hits["m-d-y"])
        hits["d-m-y"] = F.when(swapped, hits["d-m-y"]).otherwise(0)
        best = F.array_max(F.array(*[F.struct(n.cast("long").alias("n"), F.lit(-k).alias("at"), F.lit(f).alias("f")) for k, (f, n) in enumerate(hits.items())]))
        cells.append(F.struct(*cell, F.coalesce(f"v_{i}", F.lit(False)).alias("veto"), sum(hits.values(), F.lit(0)).cast("long").alias("hits"),
                              F.when(best["n"] > 0, best["f"]).alias("best_format"), swapped.alias("day_first")))
    ratio = F.coalesce(F.when(F.col("veto"), 0.0).otherwise(F.try_divide("hits", "n")), F.lit(0.0))
    counted = write_wide(readings(df, texts, read).agg(*aggs))
    table = counted.select("n", F.inline(F.array(*cells))).withColumn("parse_ratio", ratio)
    return table.select(
        "column", "position", "name_score", "parse_ratio", "best_format", "day_first",
        (~F.col("veto") & ((F.col("parse_ratio") >= threshold)
                           | ((F.col("name_score") > 0) & (F.col("parse_ratio") > 0.3)))).alias("is_date"),
        F.when(F.col("veto"), F.lit("text with percent signs")).alias("reason"))


def choose_date(detected: DataFrame, override: str | None = None) -> str | None:
    """The date column: the override, else the first detected column in table order."""
    if override:
        return override
    first = detected.where("is_date").orderBy("position").select("column").first()
    return first["column"] if first else None


def category_levels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, level, code, copies: sorted distinct values of text columns, numbered from 0."""
    cols = cols or string_columns(df)
    long = df.select(*[q(c) for c in cols]).unpivot([], cols, "column", "level")
    levels = long.where("level IS NOT NULL").groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("copies"))
    return _number_levels(levels)


def _number_levels(levels: DataFrame) -> DataFrame:
    """Dense numbering of already distinct levels without one task per column."""
    placed = write_table(levels.repartitionByRange("column", "level").withColumn(
        "chunk", F.spark_partition_id()))
    inside = W.partitionBy("chunk", "column").orderBy("level")
    sizes = placed.groupBy("chunk", "column").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("column").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select("chunk", "column", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    return placed.withColumn("_r", F.row_number().over(inside)).join(carried, ["chunk", "column"]).select(
        "column", "level", (F.col("_r") - 1 + F.col("_c")).alias("code"), "copies")


def integer_codes(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """``keep`` plus one ``<column>_code`` per column; missing values get -1."""
    out = df.select(*[q(c) for c in dict.fromkeys([*keep, *cols])])
    levels = write_table(category_levels(df, cols))
    for c in cols:
        table = levels.where(F.col("column") == c).select(
            F.col("level").alias(c), "copies", F.col("code").alias(f"{c}_code"))
        out = lookup(out, table, [c], "copies", [f"{c}_code"])
    return out.select(*keep, *[F.coalesce(f"{c}_code", F.lit(-1)).alias(f"{c}_code") for c in cols])


def one_hot(df: DataFrame, cols: list[str], keep: list[str], max_levels: int = 1000) -> DataFrame:
    """``keep`` plus one 0/1 column ``<column>_<level>`` per level.

    A level is a column of the result, so the number of levels is checked; a
    table that wide belongs in :func:`integer_codes`.
    """
    levels = category_levels(df, cols).orderBy("column", "code").select("column", "level")
    rows = levels.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} levels; use integer codes")
    by_col = {c: [r["level"] for r in rows if r["column"] == c] for c in cols}
    return df.select(*[q(c) for c in keep], *[
        F.when(q(c) == level, 1.0).otherwise(0.0).alias(f"{c}_{level}")
        for c in cols for level in by_col[c]])


def classify(df: DataFrame, date_cols: list[str], cat_cols: list[str] | None = None) -> DataFrame:
    """dataset_type, reason, n_rows, n_dates: cross_sectional, time_series, panel or unknown."""
    cat_cols = [c for c in string_columns(df) if c not in date_cols] if cat_cols is None else cat_cols
    if len(date_cols) != 1:
        kind, why = (("cross_sectional", "No date columns detected.") if not date_cols
                     else ("unknown", "Multiple date-like columns detected."))
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(kind).alias("dataset_type"), F.lit(why).alias("reason"), "n_rows",
            F.lit(None).cast("bigint").alias("n_dates"))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct(to_moment(df, date_cols[0])).alias("n_dates"))
    unique = F.col("n_rows") == F.col("n_dates")
    return one.select(
        F.when(unique, "time_series").when(F.lit(bool(cat_cols)), "panel").otherwise("unknown")
        .alias("dataset_type"),
        F.when(unique, "Single date column with unique timestamps.")
        .when(F.lit(bool(cat_cols)), "Date column + entity-like categorical column found.")
        .otherwise("Data ambiguous; user input needed.").alias("reason"), "n_rows", "n_dates")


def equal_rows(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where ``column`` equals ``value`` (reaches the scan as a pushed filter)."""
    return df.where(q(column) == F.lit(value))


def member_rows(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column table ``members``."""
    return df.join(members.select(F.col(members.columns[0]).alias(column)).distinct(), column, "left_semi")
