"""Writers: one folder per result table, and one long key/value table of everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import q


class ResultFolder:
    """Writes every result as soon as it is ready: ``<path>/operator=<name>/run_id=<id>``.

    What was written before a failure stays readable.
    """

    def __init__(self, path: str, run_id: str, file_format: str = "json"):
        if file_format not in ("json", "parquet"):
            raise ValueError(f"unknown format: {file_format}")
        self.path, self.run_id, self.file_format = path.rstrip("/"), run_id, file_format

    def write(self, operator: str, df: DataFrame) -> str:
        target = f"{self.path}/operator={operator}/run_id={self.run_id}"
        df.write.mode("overwrite").format(self.file_format).save(target)
        return target


def as_tree(results: dict[str, DataFrame]) -> DataFrame:
    """operator, row: every result row as one JSON text, all tables in one."""
    parts = [df.select(F.lit(name).alias("operator"), F.to_json(F.struct("*")).alias("row"))
             for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts)


def flatten(operator: str, df: DataFrame, subject: list[str]) -> DataFrame:
    """operator, subject, metric, value (text): one row per cell outside the subject columns."""
    metrics = [c for c in df.columns if c not in subject]
    name = F.concat_ws(".", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in subject]) if subject \
        else F.lit("")
    text = []
    for c in metrics:
        kind = df.schema[c].dataType.typeName()
        text.append((F.to_json(q(c)) if kind in ("map", "struct", "array") else q(c).cast("string")).alias(c))
    wide = df.select(name.alias("subject"), *text)
    return wide.unpivot(["subject"], metrics, "metric", "value").select(
        F.lit(operator).alias("operator"), "subject", "metric", "value")


def flatten_all(results: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [flatten(n, df, s) for n, (df, s) in results.items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
