"""Cross products and QR of tall tables, one small matrix per task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE = 64


def gramian(df: DataFrame, cols: list[str]) -> np.ndarray:
    """X'X of the (complete, double) columns. Every task adds up its own k x k matrix;
    the matrices are summed by position in Spark, so only k*k numbers reach the driver."""
    k = len(cols)

    def partial(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = pdf.to_numpy(float)
            total += x.T @ x
        yield pd.DataFrame({"pos": np.arange(k * k, dtype="int32"), "s": total.ravel()})

    parts = df.select(*[F.col(f"`{c}`") for c in cols]).mapInPandas(partial, "pos int, s double")
    out = np.zeros(k * k)
    for row in parts.groupBy("pos").agg(F.sum("s").alias("s")).collect():
        out[row["pos"]] = row["s"]
    return out.reshape(k, k)


def r_factor(df: DataFrame, cols: list[str]) -> np.ndarray:
    """R of a QR factorisation of the columns: QR per task, then of stacked R's, twice.

    Keeps the full accuracy for the singular values, which X'X would square.
    """
    k = len(cols)
    schema = "bucket int, " + ", ".join(f"c{i} double" for i in range(k))

    def factor(x: np.ndarray, bucket: int) -> pd.DataFrame:
        r = np.linalg.qr(x, mode="r") if len(x) else np.zeros((0, k))
        out = pd.DataFrame(r, columns=[f"c{i}" for i in range(k)])
        out.insert(0, "bucket", np.int32(bucket))
        return out

    def per_task(batches):
        r, bucket = np.zeros((0, k)), None
        for pdf in batches:
            bucket = int(pdf["bucket"].iloc[0]) if bucket is None and len(pdf) else bucket
            stacked = np.vstack([r, pdf.drop(columns="bucket").to_numpy(float)])
            r = np.linalg.qr(stacked, mode="r") if len(stacked) else r
        yield factor(r, bucket or 0)

    def per_bucket(pdf):
        return factor(pdf.drop(columns="bucket").to_numpy(float), 0)

    x = df.select(F.pmod(F.spark_partition_id(), F.lit(MERGE)).alias("bucket"),
                  *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    small = x.mapInPandas(per_task, schema).groupBy("bucket").applyInPandas(per_bucket, schema)
    stacked = np.array([[row[f"c{i}"] for i in range(k)] for row in small.collect()]).reshape(-1, k)
    return np.linalg.qr(stacked, mode="r")


def pseudo_inverse(g: np.ndarray, tol: float = 1e-11) -> tuple[np.ndarray, int]:
    """Inverse of a Gramian and its rank, after scaling to a unit diagonal."""
    d = np.sqrt(np.clip(np.diag(g), 0, None))
    d[d == 0] = 1.0
    vals, vecs = np.linalg.eigh(g / np.outer(d, d))
    keep = vals > tol * max(vals.max(initial=0.0), 1e-300)
    inv = (vecs[:, keep] / vals[keep]) @ vecs[:, keep].T
    return inv / np.outer(d, d), int(keep.sum())
