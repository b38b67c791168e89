"""Rows that agree with another row in all but a few columns, for tables of any width.

If two rows differ in at most ``spare`` columns and the columns are dealt into ``spare + 1`` parts, the rows agree on one
part entirely. So each row joins one bucket per part, by a 128-bit hash of its key and the part's values, and only rows that
share a bucket are compared, by their codes (see ``row_codes``), which are exact. The first part settles most rows; the other
parts are then looked at where a bucket holds a row that has no partner yet. Buckets of a bounded size are compared inside
tasks, many buckets to a task. A larger bucket is first compared in pieces, and split anew by parts of the columns that are
left if a row is open after that, until it is small or until so few columns are left that all of its rows are within reach. No
pair of rows leaves a task, and no bucket meets in one place before it is small. What grows with the rows is joined by
shuffle: a written table of repeated values is small on disk, but not in the driver's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import lookup, shuffled, write_table, write_wide
from plumbline.operators.row_codes import CODES, TEXTS, Cells, Layout, encode_rows

BUCKET_ROWS = 512      # rows of a bucket that are compared in one task
TASK_ROWS = 1 << 14    # rows of small buckets that meet in one task, about
BUCKET = ["part", "h1", "h2"]


def _deal(cols: list[str], parts: int) -> list[list[str]]:
    """``cols``, the most telling first, dealt out so that every part has telling ones."""
    return [cols[i::parts] for i in range(parts)]


def _hashes(home: list[Column], parts: dict[int, list[Column]]) -> Column:
    """An array of the buckets (part, h1, h2) of a row; ``home`` are columns that members share besides."""
    return F.array(*[F.struct(F.lit(i).alias("part"), *[
        F.xxhash64(F.lit(seed), *home, *part).alias(f"h{seed}") for seed in (1, 2)]) for i, part in parts.items()])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def _compare(row_id: str, layout: Layout, keys: list[str], compare: list[str], spare: int):
    """Function over the rows of many buckets: ids of those with a partner in their bucket."""
    def run(_: tuple, rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        bucket = np.column_stack([rows.column(c).to_numpy() for c in [*BUCKET, "piece"]]).astype(np.int64)
        order = np.lexsort(bucket.T)
        bucket = bucket[order]
        key, cells = Cells(layout, keys, rows, order), Cells(layout, compare, rows, order)
        fresh = np.append(True, (bucket[1:] != bucket[:-1]).any(1))
        end = np.append(np.flatnonzero(fresh)[1:], n)[np.cumsum(fresh) - 1]
        hit = np.zeros(n, bool)
        left, step = np.arange(n), 0
        while True:
            step += 1
            left = left[left + step < end[left]]
            if not len(left):
                break
            # Two rows that have a partner already tell nothing new.
            open_ = left[~(hit[left] & hit[left + step])]
            for at in range(0, len(open_), 4096):
                a = open_[at:at + 4096]
                near = a[(cells.apart(a, a + step) <= spare) & (key.apart(a, a + step) == 0)]
                hit[near] = hit[near + step] = True
        return pa.table({row_id: rows.column(row_id).combine_chunks().take(pa.array(order[hit]))})

    return run


def near_rows(rows: DataFrame, row_id: str, keys: list[str], compare: list[str], spare: int) -> DataFrame:
    """``row_id`` of the rows that have another row with equal ``keys`` and at most ``spare`` unequal ``compare`` columns.

    ``rows`` is a written table with a number ``row_id`` for every row. Null equals null.
    """
    coded, layout = encode_rows(rows, [row_id], keys, compare, spare + 1)
    return near_codes(write_wide(coded), row_id, layout, keys, compare, spare)


def near_codes(rows: DataFrame, row_id: str, layout: Layout, keys: list[str], compare: list[str], spare: int,
               known: DataFrame | None = None) -> DataFrame:
    """:func:`near_rows` of rows that have codes; ``known`` are ids of rows that have a partner for certain."""
    values = rows.select(row_id, CODES, *([TEXTS] if layout.texts else []))
    kind = rows.schema[row_id].dataType.simpleString()
    found = [known] if known is not None else []

    def ranked(cols: list[str]) -> list[str]:
        return [c for c in layout.telling if c in cols] + [c for c in cols if c not in layout.telling]

    def marked(ids: DataFrame) -> DataFrame:
        """With ``known``, which is null for rows without a partner so far."""
        if not found:
            return ids.withColumn("known", F.lit(None).cast("boolean"))
        return ids.join(shuffled(_union(found).withColumn("known", F.lit(True))), row_id, "left")

    def open_buckets(members: DataFrame) -> DataFrame:
        """Buckets of several rows, one of which has no partner yet: the others have nothing to tell."""
        return write_table(members.groupBy(*BUCKET).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("still")).where("n > 1 AND still > 0").drop("still"))

    def settle(at: DataFrame, home: list[Column], left: list[str], parts: list[list[str]]) -> None:
        """Flag what the buckets of ``at`` tell; split those that are too large."""
        rest = [[c for c in left if c not in part] for part in parts]
        large: list[DataFrame] = []
        for group in ([0], list(range(1, len(parts)))):
            if not group:
                continue
            hashed = at.select(row_id, _hashes(home, {i: layout.piece(parts[i]) for i in group}).alias("_b"))
            sizes = open_buckets(marked(hashed).select("known", F.explode("_b").alias("_b")).select("known", "_b.*"))
            if sizes.isEmpty():
                continue
            members = hashed.select(row_id, F.explode("_b").alias("_b")).select(row_id, "_b.*")
            met = write_table(lookup(members, sizes, BUCKET, "n", ["n"]).where("n IS NOT NULL"))
            sure = [i for i in group if len(rest[i]) <= spare]
            if sure:
                # All that is left may differ.
                found.append(write_table(met.where(F.col("part").isin(sure)).select(row_id).distinct()))
            unsure = met.where(~F.col("part").isin(sure)) if sure else met
            pieces = F.ceil(F.col("n") / max(2, BUCKET_ROWS // 2))
            placed = unsure.select(row_id, *BUCKET, F.when(F.col("n") <= BUCKET_ROWS, F.lit(0)).otherwise(
                F.pmod(F.xxhash64(F.lit(7), row_id), pieces)).alias("piece"))
            tasks = max(1, unsure.count() // TASK_ROWS)
            binned = placed.join(shuffled(values), row_id).withColumn("bin", F.pmod(F.xxhash64(*BUCKET, "piece"), F.lit(tasks)))
            found.append(write_table(binned.groupBy("bin").applyInArrow(
                _compare(row_id, layout, keys, compare, spare), f"`{row_id}` {kind}").distinct()))
            large.append(unsure.where(F.col("n") > BUCKET_ROWS).drop("n"))
        for big in large:
            for i in sorted(r[0] for r in big.select("part").distinct().collect()):
                mine = big.where(F.col("part") == i)
                unsettled = open_buckets(marked(mine))
                if unsettled.isEmpty():
                    continue
                still = lookup(mine, unsettled, BUCKET, "n", ["n"]).where("n IS NOT NULL")
                deeper = _deal(ranked(rest[i]), spare + 1)
                again = write_table(values.join(shuffled(still.select(F.col(row_id), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))), row_id))
                settle(again, [F.col("_h1"), F.col("_h2")], rest[i], deeper)

    key = layout.piece(keys)
    if len(compare) <= spare:
        # Equal keys are enough.
        settle(rows, key, [], [[]])
    else:
        first = _deal(ranked(compare), spare + 1)
        settle(rows, key, compare, first)
    return _union(found) if found else rows.select(row_id).limit(0)
