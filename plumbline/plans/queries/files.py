"""Readers, profile and writers, over files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.tables import shared_folder
from plumbline.operators import describe, missing, panel
from plumbline.plans.queries.common import rounded, table
from plumbline.plans.queries.dates import TEXT
from plumbline.plans.queries.quality import HOLES, PER_COLUMN, holes
from plumbline.sources import readers, sinks


def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/plumbline/files-{uuid.uuid4().hex}"


def _customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer")


def delimited(spark: SparkSession, folder: str, sep: str = ";") -> DataFrame:
    path = _fresh(spark)
    _customer(spark, folder).write.option("header", True).option("sep", sep).csv(path)
    return readers.read_delimited(spark, path)


def messy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as text; every 7th line has a field too many, every 5th of the rest one too few."""
    path = _fresh(spark)
    line = F.concat_ws(",", "c_custkey", "c_name", F.col("c_nationkey").cast("string"))
    rows = _customer(spark, folder).select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.concat(line, F.lit(",extra")))
                                           .when(F.col("c_custkey") % 5 == 0, F.concat_ws(",", "c_custkey", "c_name"))
                                           .otherwise(line).alias("value"))
    rows.select("value").write.text(path)
    schema = "c_custkey long, c_name string, c_nationkey int"
    reader_schema = StructType.fromDDL(schema)
    # Part files carry no header of their own, so the reader is told the columns.
    return readers.read_delimited(spark, path, delimiter=",", schema=reader_schema, header=False)


def text_checks(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for sep in (",", ";", "|"):
        path = _fresh(spark)
        _customer(spark, folder).select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option(
            "sep", sep).csv(path)
        counts = readers.delimiter_counts(spark, path).where(F.col("fewest") > 0).select(
            F.lit(sep).alias("written"), F.col("delimiter").alias("found"), "fewest", "most")
        out = counts if out is None else out.unionByName(counts)
    return out


def quoted_names(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as text whose names hold doubled quotes and delimiters, behind more than a hundred lines of notes."""
    path = _fresh(spark)
    note = spark.range(150).select(F.concat(F.lit("note "), F.col("id").cast("string")).alias("value"))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(';"'), "c_name", F.lit(' ""of"" '), "c_mktsegment",
                    F.lit('; a, b | ""c"""'), F.lit(";"), F.col("c_nationkey").cast("string"))
    note.coalesce(1).write.text(path)
    _customer(spark, folder).select(line.alias("value")).write.mode("append").text(path)
    schema = StructType.fromDDL("c_custkey long, c_name string, c_nationkey int")
    return readers.read_delimited(spark, path, schema=schema, header=False).where("c_custkey IS NOT NULL")


def sniffed(spark: SparkSession, folder: str) -> DataFrame:
    """What the sniff says of three ways to write the same customers."""
    rows = _customer(spark, folder)
    said = rows.select("c_custkey", F.concat(F.lit('say "a, b" '), "c_name").alias("c_name"))
    parts = []
    for name, options in (("doubled", {"sep": ";", "escape": '"'}), ("backslash", {"sep": "|"}), ("latin", {"sep": "\t", "encoding": "ISO-8859-1"})):
        path = _fresh(spark)
        (said if name != "latin" else rows.select("c_custkey", F.lit("é"))).write.options(**options, quoteAll=True).csv(path)
        seen = readers.sniff(spark, path)
        text = readers.sniff_table(spark, path).where((F.col("delimiter") == seen.delimiter) & (F.col("quoting") == "doubled"))
        parts.append(text.select(F.lit(name).alias("written"), F.lit(seen.delimiter).alias("delimiter"), F.lit(seen.encoding).alias("encoding"),
                                 F.lit(seen.escape).alias("escape"), "n_lines", (F.col("n_not_utf8") > 0).alias("other_bytes")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as UTF-8 and as ISO-8859-1; the second is recognised by its invalid bytes."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("é "), F.col("lang"), F.lit(" "), "source").alias("value"))
    parts = []
    for name in ("UTF-8", "ISO-8859-1"):
        path = _fresh(spark)
        docs.write.option("encoding", name).option("header", False).csv(path)
        found = readers.detect_encoding(spark, path)
        back = spark.read.option("encoding", found).csv(path)
        parts.append(back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_c0").startswith("é")).alias("n_kept")).select(
            F.lit(name).alias("written"), F.lit(found).alias("found"), "n_rows", "n_kept"))
    return parts[0].unionByName(parts[1])


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark)
    _customer(spark, folder).write.json(path)
    return readers.read_json(spark, path, multi_line=False).select(
        F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal"))


def written_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two result tables written as they finish and read back as one tree."""
    path = _fresh(spark)
    sink = sinks.ResultFolder(path, "run-1", "parquet")
    names = {"missing_columns": missing.missing_columns(holes(spark, folder)),
             "balance": panel.balance(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate")}
    for name, df in names.items():
        sink.write(name, df)
    back = {n: spark.read.parquet(f"{path}/operator={n}/run_id=run-1") for n in names}
    return sinks.as_tree(back).groupBy("operator").agg(F.count(F.lit(1)).alias("n_rows"))


def flat(spark: SparkSession, folder: str) -> DataFrame:
    one = rounded(describe.numeric_range(table(spark, folder, "lineitem"), ["l_linenumber", "l_quantity"]), min=2, max=2)
    two = missing.missing_columns(holes(spark, folder)).select("column", "dtype", "n_missing")
    return sinks.flatten_all({"range": (one, ["column"]), "missing": (two, ["column"])})


QUERIES = {
    "read_delimited_customer": (
        delimited, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "read_tab_delimited_customer": (
        lambda s, d: delimited(s, d, "\t"), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "read_messy_lines_customer": (
        messy_lines, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS c_nationkey "
                     "FROM customer WHERE c_custkey % 7 <> 0"),
    "delimiter_counts_customer": (
        text_checks, " UNION ALL ".join(f"SELECT '{c}' AS written, '{c}' AS found, 2 AS fewest, 2 AS most" for c in ",;|")),
    "read_quoted_customer": (
        quoted_names, "SELECT c_custkey, c_name || ' \"of\" ' || c_mktsegment || '; a, b | \"c\"' AS c_name, c_nationkey FROM customer"),
    "sniffed_customer": (
        sniffed, "SELECT 'doubled' AS written, ';' AS delimiter, 'UTF-8' AS encoding, '\"' AS escape, count(*) AS n_lines, false AS other_bytes "
                 "FROM customer UNION ALL SELECT 'backslash', '|', 'UTF-8', chr(92), count(*), false FROM customer "
                 "UNION ALL SELECT 'latin', chr(9), 'ISO-8859-1', '\"', count(*), true FROM customer"),
    "encodings_documents": (
        encodings, "SELECT 'UTF-8' AS written, 'UTF-8' AS found, count(*) AS n_rows, count(*) AS n_kept FROM documents "
                   "UNION ALL SELECT 'ISO-8859-1', 'ISO-8859-1', count(*), count(*) FROM documents"),
    "read_json_customer": (json_round_trip, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "read_parquet_orders": (
        lambda s, d: readers.read_table(s, f"{d}/orders.parquet").select(
            "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")),
        f"SELECT o_orderkey, o_totalprice, {TEXT.format('o_orderdate')} AS o_orderdate FROM orders"),
    "downcast_advice_lineitem": (
        lambda s, d: readers.downcast_advice(table(s, d, "lineitem")).drop("dtype"),
        "WITH a AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", min({c})::BIGINT AS lo, max({c})::BIGINT AS hi FROM lineitem"
            for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
        + ") SELECT \"column\", lo AS \"min\", hi AS \"max\", CASE WHEN lo >= -128 AND hi <= 127 THEN 'tinyint' "
          "WHEN lo >= -32768 AND hi <= 32767 THEN 'smallint' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int' "
          "ELSE 'bigint' END AS suggested_type FROM a"),
    "preview_nation": (
        lambda s, d: readers.preview(table(s, d, "nation")),
        "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"),
    "profile_lineitem": (
        lambda s, d: readers.profile(table(s, d, "lineitem")).select("position", "column", "n_rows", "n_columns"),
        "SELECT (row_number() OVER () - 1) AS position, column_name AS \"column\", (SELECT count(*) FROM lineitem) AS n_rows, "
        "11 AS n_columns FROM (DESCRIBE lineitem)"),
    "file_sizes_lineitem": (lambda s, d: readers.file_sizes(table(s, d, "lineitem")), None),
    "written_results": (
        written_results,
        f"WITH {HOLES}, {PER_COLUMN} SELECT 'missing_columns' AS operator, count(*) AS n_rows FROM c WHERE n_missing > 0 "
        "UNION ALL SELECT 'balance', 1"),
    "flattened_results": (
        flat,
        f"WITH {HOLES}, {PER_COLUMN}, r AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS subject, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem"
            for c in ("l_linenumber", "l_quantity"))
        + ") SELECT 'range' AS operator, subject, 'min' AS metric, lo::VARCHAR AS value FROM r UNION ALL "
          "SELECT 'range', subject, 'max', hi::VARCHAR FROM r UNION ALL "
          "SELECT 'missing', \"column\", 'dtype', dtype FROM c WHERE n_missing > 0 UNION ALL "
          "SELECT 'missing', \"column\", 'n_missing', n_missing::VARCHAR FROM c WHERE n_missing > 0"),
}
