"""Exact ranks over sorted data of any size and any skew.

Equal values are first collapsed to (value, copies) with map-side combining, so
no group of copies can fill a task. The distinct values are then range
partitioned, which also splits a single key over many partitions, and the rank
of each value is its rank inside the partition plus the row count of the same
key in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import attach, write_table


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Written table of distinct (keys, order) with ``copies``, range partitioned; ``chunk`` is the partition."""
    runs = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("copies"))
    # No fixed number of partitions, so that adaptive execution may merge small neighbours.
    return write_table(runs.repartitionByRange(*keys, *order).withColumn("chunk", F.spark_partition_id()))


def ranked_runs(df: DataFrame, keys: list[str], order: list[str],
                sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct (keys, order): ``copies``, ``start``, ``total``, ``prev``.

    ``start`` counts the rows of the key that sort before, ``total`` all its
    rows; ``prev`` is the preceding distinct value of the first order column.
    ``sums`` adds weighted sums over the whole key: name -> expression over the
    order columns and ``copies``; ``sum(expr)`` comes back as ``name``, and
    ``sum(expr * mean position)`` as ``name_at``.
    """
    sums = sums or {}
    placed = _placed(df, keys, order)
    inside = W.partitionBy("chunk", *keys).orderBy(*order)
    local = placed.withColumn(
        "_before", F.coalesce(F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, -1)),
                              F.lit(0))
    ).withColumn("_prev", F.lag(order[0]).over(inside))

    middle = F.col("_before") + (F.col("copies") - 1) / 2.0
    per_chunk = local.groupBy("chunk", *keys).agg(
        F.sum("copies").alias("_rows"), F.max(order[0]).alias("_last"),
        *[F.sum(e).alias(f"_{k}") for k, e in sums.items()],
        *[F.sum(e * middle).alias(f"_{k}_at") for k, e in sums.items()])
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("chunk")
    carried = per_chunk.withColumn(
        "_carry", F.coalesce(F.sum("_rows").over(earlier.rowsBetween(W.unboundedPreceding, -1)),
                             F.lit(0))
    ).select(
        "chunk", *keys, "_carry", F.lag("_last").over(earlier).alias("_prev_chunk"),
        F.sum("_rows").over(whole).alias("total"),
        *[F.sum(f"_{k}").over(whole).alias(k) for k in sums],
        *[F.sum(F.col(f"_{k}_at") + F.col("_carry") * F.col(f"_{k}")).over(whole).alias(f"{k}_at")
          for k in sums])
    return local.join(carried, ["chunk", *keys]).select(
        "chunk", *keys, *order, "copies",
        (F.col("_before") + F.col("_carry")).alias("start"), "total",
        F.coalesce("_prev", "_prev_chunk").alias("prev"),
        *list(sums), *[f"{k}_at" for k in sums])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per key, one column per probability."""
    placed = _placed(df.where(F.col(value).isNotNull()), keys, [value])
    whole = W.partitionBy(*keys)
    sizes = placed.groupBy("chunk", *keys).agg(F.sum("copies").alias("_rows"))
    sizes = sizes.withColumn("_carry", F.sum("_rows").over(whole.orderBy("chunk").rowsBetween(
        W.unboundedPreceding, 0)) - F.col("_rows")).withColumn("_n", F.sum("_rows").over(whole))
    spots = {f"_{name}_{side}": near(F.lit(p) * (F.col("_n") - 1)) for name, p in probs.items()
             for side, near in (("lo", F.floor), ("hi", F.ceil))}
    # Only the chunks that hold a wanted position are ranked row by row.
    wanted = F.lit(False)
    for pos in spots.values():
        wanted = wanted | ((F.col("_carry") <= pos) & (pos < F.col("_carry") + F.col("_rows")))
    inside = W.partitionBy("chunk", *keys).orderBy(value)
    rows = placed.join(sizes.where(wanted), ["chunk", *keys]).withColumn(
        "_end", F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("_carry"))
    start = F.col("_end") - F.col("copies")
    picked = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        F.max(F.when((start <= pos) & (pos < F.col("_end")), F.col(value))).alias(name)
        for name, pos in spots.items()])
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *out)


def attach_by_chunk(runs: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return attach(runs, stats, keys, "chunk")


def explode_range(df: DataFrame, first: Column, last: Column, name: str,
                  step: int = 1 << 16) -> DataFrame:
    """One row per integer in [first, last]; long ranges are split over tasks first."""
    pieces = df.withColumn("_first", first).withColumn("_last", last).where("_last >= _first")
    pieces = pieces.withColumn(
        "_piece", F.explode(F.sequence(F.floor(F.col("_first") / step), F.floor(F.col("_last") / step))))
    spread = pieces.repartition("_piece", *[c for c in df.columns])
    lo = F.greatest(F.col("_first"), F.col("_piece") * step)
    hi = F.least(F.col("_last"), (F.col("_piece") + 1) * step - 1)
    return spread.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_first", "_last", "_piece")
