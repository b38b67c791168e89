"""Written intermediate tables.

A rank or a prefix sum is read by several branches of one job, and its range
boundaries come from sampling, so it has to be fixed before it is read twice.
It is written as Parquet below the checkpoint folder the cluster names, which
also cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, else one on the session's default file system.

    Without the setting a local file system would do for one machine only, so a cluster must name a shared folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(hadoop).toString().rstrip("/")
        if root.startswith("file:"):
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://"
        named = f"{root}/tmp/plumbline-{spark.sparkContext.sparkUser()}/{spark.sparkContext.applicationId}"
    return named.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_wide(df: DataFrame) -> DataFrame:
    """:func:`write_table` of a table whose columns are many expressions.

    Side by side in one generated method they pass the 8,000 bytes up to which HotSpot compiles, and would be interpreted.
    """
    with setting(df.sparkSession, METHOD_LIMIT, "8000"):
        return write_table(df)


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written copy.

    Nothing reads the shuffle files of the write again, so they go at its end; else they stay on disk until the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{uuid.uuid4().hex}"
    with setting(spark, FILE_CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_row(left: str, right: str, cols: list[str]) -> Column:
    """Null-safe equality of ``cols`` between two aliased sides (still an equi-join)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return cond


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the data: never broadcast.

    Spark goes by the size of the files. Repeated values take little room there, so a few megabytes may hold millions of rows,
    which would pass whole through the driver.
    """
    return df.hint("merge")


HOT_GROUPS = 1000


def lookup(rows: DataFrame, groups: DataFrame, cols: list[str], size_col: str,
           values: list[str]) -> DataFrame:
    """Left-join per-group ``values`` to ``rows`` on null-safe equality of ``cols``.

    ``groups`` is a written table with one row per group and its row count in
    ``size_col``. The largest groups (fewer than ``HOT_GROUPS`` of them, whatever
    the data size) go through a broadcast join and never meet in one task; a
    group that is not among them holds at most 1/``HOT_GROUPS`` of all rows and
    goes through an ordinary shuffle join.
    """
    cut, n = groups.select(size_col).orderBy(F.desc(size_col)).limit(HOT_GROUPS).agg(
        F.min(size_col), F.count(F.lit(1))).first()
    keep = [F.col(f"l.`{c}`") for c in rows.columns] + [F.col(f"g.`{v}`") for v in values]
    slim = groups.select(*cols, size_col, *[v for v in values if v != size_col])
    cond = same_row("l", "g", cols)
    if n < HOT_GROUPS:
        return rows.alias("l").join(F.broadcast(slim).alias("g"), cond, "left").select(*keep)
    hot = F.broadcast(slim.where(F.col(size_col) > cut))
    cold = slim.where(F.col(size_col) <= cut)
    in_hot = rows.alias("l").join(hot.alias("g"), cond, "inner").select(*keep)
    rest = rows.alias("l").join(hot.alias("g"), cond, "left_anti")
    return in_hot.unionByName(rest.alias("l").join(shuffled(cold).alias("g"), cond, "left").select(*keep))


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Inner-join one row of ``stats`` per ``keys`` to ``rows``.

    ``unit`` is a column that splits every key into pieces of bounded size
    (a chunk or a block). The statistics are first copied to the pieces, so the
    big join is on (piece, key) and a key with most of the rows is spread.
    """
    pieces = rows.select(*keys, unit).distinct().join(stats, keys)
    return rows.join(pieces, [*keys, unit])
