"""Ordered series of any length, cut into blocks of bounded size.

A :class:`Series` is a written table with one row per observation:
``keys..., block, t, ts, y, n, mean, slope``. ``t`` is the 0-based position by
(ts, y) inside the series, ``block = t div block_size``. Operators group and
window by (keys, block), never by the series alone, so one long series is as
well spread as many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import to_moment, to_number
from plumbline.functions.runs import ranked_runs
from plumbline.functions.tables import attach, write_table

BLOCK_ROWS = 1 << 18


@dataclass(frozen=True)
class Series:
    rows: DataFrame
    keys: list[str]
    block_rows: int = BLOCK_ROWS

    def demeaned(self) -> Column:
        return F.col("y") - F.col("mean")

    def detrended(self) -> Column:
        return self.demeaned() - F.col("slope") * (F.col("t") - (F.col("n") - 1) / 2.0)

    def one_row_each(self) -> DataFrame:
        """keys, n: one row per series."""
        return self.rows.groupBy(*self.keys).agg(F.max("n").alias("n"))

    def attach(self, stats: DataFrame) -> DataFrame:
        return attach(self.rows, stats, self.keys, "block")


def build_series(df: DataFrame, date_col: str, value_cols: list[str], keys: list[str] | None = None,
                 block_rows: int = BLOCK_ROWS) -> Series:
    """Order every (keys, value column) of ``df`` by date; rows without date or value are left out."""
    keys = list(keys or [])
    wide = df.select(*keys, to_moment(df, date_col).alias("ts"),
                     *[to_number(df, c).alias(c) for c in value_cols])
    long = wide.unpivot([*keys, "ts"], value_cols, "series", "y")
    long = long.where(F.col("y").isNotNull() & F.col("ts").isNotNull()).dropna(subset=keys or None)
    return order_series(long, [*keys, "series"], block_rows)


def order_series(long: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> Series:
    """``long`` holds keys..., ts, y; see :class:`Series` for what comes out."""
    y, copies = F.col("y"), F.col("copies")
    runs = ranked_runs(long.select(*keys, "ts", "y"), keys, ["ts", "y"],
                       sums={"sum_y": y * copies})
    n = F.col("total")
    mean = F.col("sum_y") / n
    cross = F.col("sum_y_at") - (n - 1) / 2.0 * F.col("sum_y")
    slope = F.when(n > 1, cross / (n.cast("double") * (n.cast("double") * n - 1) / 12.0))
    runs = runs.select(*keys, "ts", "y", "copies", "start", n.alias("n"), mean.alias("mean"),
                       F.coalesce(slope, F.lit(0.0)).alias("slope"))
    size = F.lit(block_rows)
    end = F.col("start") + copies
    pieces = runs.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / size), F.floor((end - 1) / size))))
    spread = pieces.repartition(*[F.col(k) for k in keys], F.col("block"))
    first = F.greatest(F.col("start"), F.col("block") * size)
    last = F.least(end, (F.col("block") + 1) * size) - 1
    rows = spread.withColumn("t", F.explode(F.sequence(first, last)))
    rows = rows.select(*keys, "block", "t", "ts", "y", "n", "mean", "slope")
    return Series(write_table(rows), keys, block_rows)


def with_halo(series: Series, rows: DataFrame, back: Column | int, ahead: Column | int = 0) -> DataFrame:
    """Copy to each block the ``back`` rows before it and the ``ahead`` rows after it.

    ``core`` marks the rows that belong to the block.
    """
    size = F.lit(series.block_rows)
    back = F.lit(back) if isinstance(back, int) else back
    ahead = F.lit(ahead) if isinstance(ahead, int) else ahead
    own = F.col("block")
    low = F.greatest(F.floor((F.col("t") - ahead) / size), F.lit(0))
    high = F.least(F.floor((F.col("t") + back) / size), F.floor((F.col("n") - 1) / size))
    return rows.withColumn("_own", own).withColumn(
        "block", F.explode(F.sequence(low, high))
    ).withColumn("core", F.col("_own") == F.col("block")).drop("_own")


def running_sums(series: Series, rows: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add, per name, the sum of the expression over all rows of the series up to and with t."""
    keys = series.keys
    rows = rows.select("*", *[e.alias(f"_v_{k}") for k, e in cols.items()])
    per_block = rows.groupBy(*keys, "block").agg(*[F.sum(f"_v_{k}").alias(f"_b_{k}") for k in cols])
    earlier = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "block", *[F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0.0)).alias(f"_c_{k}")
                          for k in cols])
    inside = W.partitionBy(*keys, "block").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_i_{k}") for k in cols]).join(
        carried, [*keys, "block"])
    for k in cols:
        out = out.withColumn(k, F.col(f"_i_{k}") + F.col(f"_c_{k}")).drop(f"_v_{k}", f"_i_{k}", f"_c_{k}")
    return out
