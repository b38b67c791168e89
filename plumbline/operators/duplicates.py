"""Duplicate rows: exact copies, and near copies on the same date or entity and date.

Rows are first collapsed to distinct rows with a copy count. Distinct rows that
differ in a few of the compared columns are found in ``near_rows``, exactly and
for any width.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import NESTED, nulls_for_nan, q, type_of
from plumbline.functions.tables import lookup, shuffled, write_table, write_wide
from plumbline.operators.near_rows import near_codes
from plumbline.operators.row_codes import encode_rows

# Names that mark a column as the date or the entity when none is given.
DATE_WORDS = ["date", "time", "timestamp", "period"]
ENTITY_WORDS = ["entity", "id", "ticker", "symbol", "company"]


def guess_column(columns: list[str], words: list[str]) -> str | None:
    """First column whose name contains one of the words."""
    return next((c for c in columns if any(w in c.strip().lower() for w in words)), None)


def allowed_mismatches(n_compare: int, threshold: float) -> int:
    return n_compare - math.ceil(n_compare * threshold)


def _possible_copies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose 64-bit row hash occurs more than once.

    Only hashes are shuffled to find them, so a table with few copies is not
    moved as a whole. Different rows may share a hash; callers compare values.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[q(c) for c in cols]))
    repeated = write_table(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"))
    found = lookup(hashed, repeated, ["_hash"], "_times", ["_times"])
    return found.where("_times IS NOT NULL").drop("_hash", "_times")


def duplicate_groups(df: DataFrame, row_id: str, cols: list[str] | None = None) -> DataFrame:
    """group_id (smallest row id), copies, and the columns; one row per group of identical rows."""
    cols = cols or [c for c in df.columns if c != row_id]
    return _possible_copies(nulls_for_nan(df), cols).groupBy(*[q(c) for c in cols]).agg(
        F.min(q(row_id)).alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def first_groups(df: DataFrame, row_id: str, entity: str | None = None, date: str | None = None,
                 max_groups: int = 300) -> DataFrame:
    """The report's group list: the first groups by smallest row id, with their key values as text."""
    cols = [c for c in df.columns if c != row_id]
    shown = [c for c in (entity, date) if c in cols] or cols[:3]
    return duplicate_groups(df, row_id).orderBy("group_id").limit(max_groups).select(
        "group_id", "copies", *[q(c).cast("string").alias(f"key_{c}") for c in shown])


def group_members(df: DataFrame, row_id: str) -> DataFrame:
    """group_id, row id: every row of every group of identical rows (long form, no lists)."""
    cols = [c for c in df.columns if c != row_id]
    groups = write_table(duplicate_groups(df, row_id))
    found = lookup(nulls_for_nan(df), groups, cols, "copies", ["group_id"])
    return found.where("group_id IS NOT NULL").select("group_id", row_id)


def flag_duplicates(df: DataFrame, row_id: str, entity: str | None = None, date: str | None = None,
                    threshold: float = 0.95) -> DataFrame:
    """row id, rule_a, rule_b, rule_c, is_duplicate, group_id for every row.

    rule_a: identical row; rule_b: same date and at least ``threshold`` of the
    other columns equal; rule_c: the same within entity and date. A rule whose
    columns are not named is false for all rows. Rows are written once as short
    exact codes and collapsed to distinct rows; those with few unequal columns
    are found by ``near_rows``.
    """
    df = nulls_for_nan(df)
    cols = [c for c in df.columns if c != row_id]
    rules = {"rule_b": [date] if date else None,
             "rule_c": [entity, date] if entity and date else None}
    spare = {r: allowed_mismatches(len([c for c in cols if c not in k]), threshold)
             for r, k in rules.items() if k is not None}
    if not any(m > 0 for m in spare.values()):
        # All compared columns equal on an equal key is an identical row: one rule answers all.
        groups = duplicate_groups(df, row_id, cols).withColumn("rule_a", F.lit(True))
        for rule, keys in rules.items():
            groups = groups.withColumn(rule, F.lit(keys is not None))
        return _flag_rows(df, row_id, cols, write_table(groups))
    keys = list(dict.fromkeys(k for k in (date, entity) if k))
    nested = [c for c in cols if isinstance(type_of(df, c), NESTED)]
    coded, layout = encode_rows(df, [row_id, *nested], keys, [c for c in cols if c not in keys], max(spare.values()) + 1)
    coded = write_wide(coded)
    # Numbered before they are written, so that the numbers stay.
    distinct = write_table(coded.groupBy(*[q(c) for c in layout.exact]).agg(
        F.count(F.lit(1)).alias("copies"), F.min(q(row_id)).alias("first_id")).withColumn(
        "distinct_row", F.monotonically_increasing_id()))
    exact = F.col("copies") > 1
    marked = distinct.withColumns({"rule_a": exact, "group_id": F.when(exact, F.col("first_id"))})
    near: dict[str, DataFrame] = {}
    # Near within entity and date is near on the date too, where as many columns may differ there.
    for rule in ("rule_c", "rule_b"):
        if spare.get(rule, 0) > 0:
            known = near.get("rule_c") if spare[rule] >= spare.get("rule_c", 0) else None
            near[rule] = write_table(near_codes(distinct, "distinct_row", layout, rules[rule], [c for c in cols if c not in rules[rule]], spare[rule], known))
    for rule, keys in rules.items():
        if keys is None:
            marked = marked.withColumn(rule, F.lit(False))
        elif rule not in near:
            marked = marked.withColumn(rule, F.col("rule_a"))
        else:
            marked = marked.join(shuffled(near[rule].withColumn("_near", F.lit(True))), "distinct_row", "left").withColumn(
                rule, F.col("rule_a") | F.coalesce("_near", F.lit(False))).drop("_near")
    flagged = write_table(marked.where("rule_a OR rule_b OR rule_c").drop("first_id", "distinct_row"))
    return _flag_rows(coded, row_id, layout.exact, flagged)


def _flag_rows(df: DataFrame, row_id: str, cols: list[str], groups: DataFrame) -> DataFrame:
    out = lookup(df, groups, cols, "copies", ["rule_a", "rule_b", "rule_c", "group_id"])
    flags = [F.coalesce(r, F.lit(False)).alias(r) for r in ("rule_a", "rule_b", "rule_c")]
    return out.select(row_id, *flags, F.col("rule_a").isNotNull().alias("is_duplicate"), "group_id")


def key_duplicates(df: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """row id, copies: rows whose key occurs more than once (a table with nothing else to compare)."""
    groups = write_table(df.groupBy(*[q(c) for c in keys]).agg(
        F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    return lookup(df, groups, keys, "copies", ["copies"]).where("copies IS NOT NULL").select(
        row_id, "copies")


def duplicate_rates(flags: DataFrame) -> DataFrame:
    """One row: flagged rows in all and per rule, and the share of all rows (4 digits)."""
    return flags.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_duplicate").alias("duplicate_count"),
        F.count_if("rule_a").alias("rule_a"), F.count_if("rule_b").alias("rule_b"),
        F.count_if("rule_c").alias("rule_c")
    ).withColumn("duplicate_percentage", F.coalesce(
        F.round(F.try_divide("duplicate_count", "n_rows") * 100, 4), F.lit(0.0)))


def duplicate_sample(df: DataFrame, flags: DataFrame, row_id: str, limit: int = 500) -> DataFrame:
    """The first ``limit`` flagged rows by row id, with ``truncated`` when there are more."""
    first = flags.where("is_duplicate").select(row_id).orderBy(row_id).limit(limit + 1)
    ranked = df.join(F.broadcast(first), row_id, "left_semi").orderBy(row_id)
    n_more = first.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return ranked.limit(limit).withColumn("truncated", n_more.scalar())
