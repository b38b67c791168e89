"""Mix sources to target weights: random order, distributed prefix sums, exact budgets.

Rules for edge cases: a null text has size 0, a null source is a source of its own (sorted last), sources without words
get target 0; a null ``doc_id`` sorts first among equal keys; repeated rows each count; an empty table gives an empty
result; other columns are ignored unless they are carried, and then come back inside one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.runs import ranked_runs
from plumbline.functions.tables import write_table
from plumbline.llm.common import table, word_count

SHARE, WEIGHTS, MOST = 1.5, (3, 1, 2), 2.0


def source_targets(totals: DataFrame, share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``totals`` (``_null``, ``_source``, ``source_size``; one row per source) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. All share ``share`` times the whole size by weight, but
    none gets over ``most`` times its own size; the level at which the others stand is found by a few sums.
    """
    ranks = ranked_runs(totals, [], ["_null", "_source"]).select("_null", "_source", "start")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("start") % len(weights) + 1).cast("int"))
    rows = write_table(totals.join(ranks, ["_null", "_source"]).select("_null", "_source", "source_size", weight.alias("_w")))
    cap, budget = F.lit(most) * F.col("source_size"), share * (rows.agg(F.sum("source_size")).head()[0] or 0)
    level, capped, done = None, F.lit(False), -1
    while True:
        full, n, w = rows.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.count_if(capped),
                              F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0))).head()
        if n == done or w == 0:
            break
        done, level = n, (budget - full) / w
        capped = cap <= F.lit(level) * F.col("_w")
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("_w"))
    return rows.select("_null", "_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry=(), share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Per document ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (and ``row``, a struct of ``carry``).

    Documents stand in the order of a hash of their id. A source takes whole epochs while its budget lasts, then the
    documents up to the exact word where the rest ends, so taken words are ``floor(target)`` per source. The order is by
    range partitions of (source, key), which cut a hot source too; a document's prefix sum is the one in its partition
    plus the totals of earlier partitions.
    """
    row = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    sized = docs.select(F.col("doc_id"), F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"),
                        word_count(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id").cast("string")).alias("_key"), *row)
    order = ["_null", "_source", "_key", "doc_id", "size"]
    placed = write_table(sized.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    parts = write_table(placed.groupBy("_chunk", "_null", "_source").agg(F.sum("size").alias("_words")))
    targets = source_targets(parts.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size")), share, weights, most)
    earlier = W.partitionBy("_null", "_source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("_carry", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).join(
        targets, ["_null", "_source"]).drop("_words")
    inside = W.partitionBy("_chunk", "_null", "_source").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_carry")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return summed.join(carried, ["_chunk", "_null", "_source"]).select(
        "doc_id", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), taken.cast("long").alias("taken"),
        *(["row"] if carry else []))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per epoch taken, the last one cut after its last word."""
    rows = mix(docs, carry=docs.columns, **options).where("taken > 0").select("row", "size", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))),
        lambda e: F.least(F.col("taken") - e * F.col("size"), F.col("size")))).alias("_n"))
    # Pieces end where a word ends, so that the first n of them are the first n words with the white space between.
    pieces = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_n") == F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(pieces, 1, F.col("_n").cast("int")), ""))
    return rows.withColumn("_text", text).select(*[
        (F.col("_text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9(spark, folder):
    return mix(table(spark, folder, "documents"))

