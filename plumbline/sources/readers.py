"""Readers: delimited text, JSON and Parquet, plus checks of delimiter and encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import INTEGRAL, columns_of, nested_columns, q

# Delimiters that are tried, in this order on ties.
DELIMITERS = [",", ";", "\t", "|"]
ODD_LINE = "_odd_line"


ESCAPES = {"doubled": '"', "backslash": "\\"}


def _bare(value: Column, escape: str, delimiters: str) -> Column:
    """The line without its quoted fields; a quote opens a field only at its start."""
    inner = '[^"]|""' if escape == '"' else r'[^"\\]|\\.'
    return F.regexp_replace(value, rf'(?:^|(?<=[{delimiters}]))"(?:{inner})*"', "")


def _classed(delimiters: list[str]) -> str:
    return "".join(f"\\{d}" if d in "\\]^-|[" else d for d in delimiters)


def sniff_table(spark: SparkSession, path: str) -> DataFrame:
    """quoting, delimiter, position, fewest, most, usual, n_usual, n_lines, n_escaped, n_not_utf8 over the whole text.

    One pass over all lines with something in them: how often each delimiter stands outside quotes, read with either way to write
    a quote inside quotes. ``usual`` is the most common count above zero, ``n_usual`` the lines that have it; ``n_escaped``
    counts lines with a quote written this way, and ``n_not_utf8`` those with bytes that are not UTF-8.
    """
    value = F.col("value")
    found = {"doubled": value.rlike(r'"[^",;\t|]*""[^",;\t|]'), "backslash": value.contains('\\"')}
    cells = [F.struct(F.lit(style).alias("quoting"), F.lit(d).alias("delimiter"), F.lit(i).alias("position"),
                      (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("k"), found[style].alias("escaped"))
             for style, escape in ESCAPES.items() for bare in [F.col(style)] for i, d in enumerate(DELIMITERS)]
    lines = spark.read.text(path).where(F.length("value") > 0).select(
        "value", *[_bare(value, escape, _classed(DELIMITERS)).alias(style) for style, escape in ESCAPES.items()])
    counts = lines.select((~F.is_valid_utf8("value")).alias("bad"), F.inline(F.array(*cells))).groupBy(
        "quoting", "delimiter", "position", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if("escaped").alias("e"), F.count_if("bad").alias("b"))
    usual = F.max_by("k", F.when(F.col("k") > 0, F.struct("n", "k")))
    return counts.groupBy("quoting", "delimiter", "position").agg(
        F.min("k").alias("fewest"), F.max("k").alias("most"), F.coalesce(usual, F.lit(0)).alias("usual"),
        F.coalesce(F.max(F.when(F.col("k") > 0, F.col("n"))), F.lit(0)).alias("n_usual"), F.sum("n").alias("n_lines"),
        F.sum("e").alias("n_escaped"), F.sum("b").alias("n_not_utf8"))


@dataclass(frozen=True)
class Sniffed:
    """What a look at the whole text says of how to read it."""

    delimiter: str
    encoding: str
    escape: str


def sniff(spark: SparkSession, path: str) -> Sniffed:
    """Delimiter, encoding and quoting from one pass.

    The delimiter is the one whose usual number of occurrences is that of the most lines, the most frequent one on ties, else
    the comma. Text that is not UTF-8 throughout is read as ISO-8859-1, which accepts any byte. Quotes inside quotes are
    doubled unless only backslashes occur before them.
    """
    rows = sniff_table(spark, path).collect()
    escaped = {r["quoting"]: r["n_escaped"] for r in rows}
    style = "backslash" if escaped.get("backslash") and not escaped.get("doubled") else "doubled"
    usable = [r for r in rows if r["quoting"] == style and r["usual"]]
    best = min(usable, key=lambda r: (-r["n_usual"], -r["usual"], r["position"]))["delimiter"] if usable else ","
    return Sniffed(best, "ISO-8859-1" if any(r["n_not_utf8"] for r in rows) else "UTF-8", ESCAPES[style])


def delimiter_counts(spark: SparkSession, path: str) -> DataFrame:
    """delimiter, position, fewest, most, usual, n_usual, n_lines: occurrences per line outside quotes (doubled inside)."""
    return sniff_table(spark, path).where("quoting = 'doubled'").select(
        "delimiter", "position", "fewest", "most", "usual", "n_usual", "n_lines")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    return sniff(spark, path).delimiter


def detect_encoding(spark: SparkSession, path: str) -> str:
    return sniff(spark, path).encoding


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
                   schema: T.StructType | None = None, multi_line: bool = False,
                   header: bool = True, escape: str | None = None) -> DataFrame:
    """Delimited text, by default with a header row in every file.

    Lines with too many fields are left out, lines with too few are filled with
    NULL. What is not given is found out in one pass (see :func:`sniff`). Give
    ``schema`` for big inputs; inferring it costs one more scan.
    """
    if delimiter is None or encoding is None or escape is None:
        seen = sniff(spark, path)
        delimiter, encoding, escape = delimiter or seen.delimiter, encoding or seen.encoding, escape or seen.escape
    reader = spark.read.option("header", header).option("sep", delimiter).option("encoding", encoding).option(
        "multiLine", multi_line).option("enforceSchema", True).option("quote", '"').option("escape", escape)
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
    # The parser keeps a line whose number of fields is not the header's in a column of its own. Columns are not pruned,
    # so that it counts the fields of every line, however few columns are read.
    names = [f.name for f in schema.fields]
    full = T.StructType([*schema.fields, T.StructField(ODD_LINE, T.StringType())])
    rows = reader.schema(full).option("mode", "PERMISSIVE").option("columnPruning", False).option(
        "columnNameOfCorruptRecord", ODD_LINE).csv(path)
    # Delimiters outside quotes; lines that are only short, or have a field of another type, stay.
    bare = _bare(F.col(ODD_LINE), escape, _classed([*delimiter]))
    found = (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter)
    # The kept line may not be the only column that a query reads, so the condition reads the first one too.
    first = F.length(F.coalesce(q(names[0]).cast("string"), F.lit(""))) >= 0
    rows = rows.where(first & (F.col(ODD_LINE).isNull() | (found < len(names))))
    return rows.select(*[q(c).alias(c.lstrip("\ufeff")) for c in names])


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files that hold one document over several lines, such as an array; files with a record on every line)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("line"), F.trim("value", F.lit(" \t\r\ufeff")).alias("v"))
    first = lines.where("v <> ''").groupBy("file").agg(F.min_by("v", F.struct("at", "line")).alias("v"))
    by_line = F.col("v").startswith("{") & F.col("v").endswith("}")
    found = first.select("file", by_line.alias("by_line")).collect()
    return [r[0] for r in found if not r[1]], [r[0] for r in found if r[1]]


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multi_line: bool | None = None) -> DataFrame:
    """An array of records, or one record per line (splittable).

    Without ``multi_line`` the first line with something in it decides for every file.
    """
    def read(paths, several: bool) -> DataFrame:
        reader = spark.read.option("multiLine", several)
        return (reader.schema(schema) if schema else reader).json(paths)

    if multi_line is not None:
        return read(path, multi_line)
    whole, lines = _json_files(spark, path)
    if whole and lines:
        return read(whole, True).unionByName(read(lines, False), allowMissingColumns=True)
    return read(whole, True) if whole else read(lines or path, False)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by the ending: ``.json``, ``.parquet``, anything else is delimited text."""
    name = path.rstrip("/").lower()
    if name.endswith((".xlsx", ".xls")):
        raise ValueError("Spreadsheet files are single-machine; save the sheet as CSV or Parquet")
    if name.endswith(".json"):
        return read_json(spark, path, **options)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_delimited(spark, path, **options)


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows, every column as text."""
    return df.limit(rows).select(*[q(c).cast("string").alias(c) for c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """position, column, dtype, is_nested, n_rows, n_columns: one row per column."""
    nested = set(nested_columns(df))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return one.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                 F.lit(c in nested).alias("is_nested"))
        for i, (c, t) in enumerate(df.dtypes)]))).withColumn("n_columns", F.lit(len(df.columns)))


def file_sizes(df: DataFrame) -> DataFrame:
    """n_files, megabytes of the files a DataFrame reads directly."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"),
                     F.round(F.sum("file_size") / (1 << 20), 2).alias("megabytes"))


def downcast_advice(df: DataFrame) -> DataFrame:
    """column, dtype, min, max, suggested_type: the smallest integer type that holds every value."""
    cols = columns_of(df, INTEGRAL)
    kinds = dict(df.dtypes)
    one = df.agg(*[F.min(q(c)).cast("bigint").alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(q(c)).cast("bigint").alias(f"hi{i}") for i, c in enumerate(cols)])
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"lo{i}").alias("min"),
                 F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])))
    fits = lambda bits: (F.col("min") >= -(1 << bits)) & (F.col("max") < (1 << bits))
    return rows.withColumn("suggested_type", F.when(F.col("min").isNull(), F.col("dtype")).when(
        fits(7), "tinyint").when(fits(15), "smallint").when(fits(31), "int").otherwise("bigint"))


def downcast(df: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Cast integer columns to the suggested types."""
    kinds = {r["column"]: r["suggested_type"] for r in (advice or downcast_advice(df)).collect()}
    return df.select(*[q(c).cast(kinds[c]).alias(c) if c in kinds else q(c) for c in df.columns])
