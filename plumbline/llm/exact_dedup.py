"""Exact duplicates: 128-bit content hash first, bytes decide.

Rules for edge cases: a null text equals an empty one; a null ``doc_id`` sorts below every number, and a group of null
ids only has a null ``keep_id`` and keeps each of its rows; repeated rows (same id and text) are members of one group and
share its verdict; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm import bloom


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, keep: str = "max", hash_of=md5_128) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is ``min`` or ``max``: which id of equal texts stays. Hashes that occur once are settled by counting. Texts
    travel only where a hash occurs twice (found through a blocked Bloom filter of such hashes): they are grouped by
    (hash, bytes), so equal bytes meet in the map task already and a group of any size reduces to one row per task.
    """
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").alias("doc_id"), text.alias("_text")).withColumn("_hash", hash_of(F.col("_text")))
    rows = seen.select("doc_id", "_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"))
    hashes = write_table(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), best("doc_id").alias("_best")))
    repeated = hashes.where("_n > 1").select("_hash")
    maybe = bloom.probe(seen, "_hash", bloom.build(repeated, "_hash"), "_maybe").where("_maybe")
    by_bytes = maybe.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"), best("doc_id").alias("_best"))
    classes = by_bytes.where("_n > 1").select(
        "_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), "_n", "_best")
    # Rows of a hot group are spread by adaptive execution, which splits the skewed side of this join.
    out = rows.alias("r").join(classes.alias("c"), ["_hash", "_sha"], "left").select(
        F.col("r.doc_id").alias("doc_id"),
        F.when(F.col("c._n").isNotNull(), F.col("c._best")).otherwise(F.col("r.doc_id")).alias("keep_id"),
        F.coalesce(F.col("c._n"), F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def drop_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, each (id, text) once; all columns as they are."""
    stays = exact_duplicates(docs, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_s"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_s": F.sha2(text.cast("binary"), 256)})
    return keyed.join(stays.distinct(), keyed["_id"].eqNullSafe(stays["_id"]) & (keyed["_s"] == stays["_s"]),
                      "left_semi").drop("_id", "_s")


def op5(spark, folder):
    from plumbline.llm.common import table
    return exact_duplicates(table(spark, folder, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
