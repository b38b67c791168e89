"""Exact top-k search by inner product: vectors in ranges, best blocks first, until no bound reaches the k-th score.

Every component becomes floor(scale * x), so that scores are integers. Tasks cut the rows they read, in the order of the
table, into blocks and keep for each block its vectors (the forward index) and the greatest and least value of every
component. A query's bound for a block is the sum of its weights times those extremes. Each query takes the blocks by falling
bound, in groups of 1, 2, 4, ... blocks, and stops where the bound is below its k-th score so far; blocks at exactly that
score are still scored, since ties go to the smaller id. Queries that want the same block are scored together.

The queries are a stated set (every id divisible by ``every``). They go to the tasks in slabs of a fixed number of values,
one pass over the rows per slab; rows are never shuffled, and each task sends at most k rows per query on.

Rules for edge cases: rows whose vector is null or holds null or non-finite components, or that have no id, take no part;
shorter vectors count as padded with zeros; an id in several rows asks once, with the smallest of its vectors, never finds
rows of its own id, and is found once per row; with fewer than k candidates all of them come; scores beyond a long are held at
its limits, scaled components at +-1e300; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import shared_folder, write_table
from plumbline.llm.common import padded, sound_vector, table

K, EVERY, SCALE = 20, 20, 64
BLOCK_ROWS = 256            # rows of a block
PART_ROWS = 1 << 15         # rows that a task holds at once
SLAB_VALUES = 1 << 22       # components of the queries that go to the tasks at once: 32 MB
QUERIES = 1024              # queries scored together
LONG = np.iinfo(np.int64)


class Best:
    """The best ``k`` (score, id) of every query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k            # ids ascending
        self.score = np.full((len(ids), k), LONG.min)
        self.found = np.zeros((len(ids), k), np.int64)
        self.n = np.zeros(len(ids), np.int64)
        self.scored_blocks = self.seen_blocks = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a range of rows."""
        cuts = np.arange(0, len(ids), BLOCK_ROWS)
        high, low = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
        for lo in range(0, len(self.ids), QUERIES):
            self._meet(slice(lo, lo + QUERIES), ids, rows, cuts, high, low)

    def _meet(self, part: slice, ids: np.ndarray, rows: np.ndarray, cuts: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        asking = self.vectors[part]
        # Sums of products below 2^53 are exact in doubles, whatever their order.
        exact = float(np.abs(asking).max(0, initial=0.0) @ np.maximum(np.abs(high), np.abs(low)).max(0)) < 2.0 ** 53
        bound = np.maximum(asking, 0) @ high.T + np.minimum(asking, 0) @ low.T if exact else np.full((len(asking), len(cuts)), np.inf)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        self.seen_blocks += bound.size
        done, step = 0, 1
        while done < len(cuts):
            live = (rank >= done) & (rank < done + step) & (bound >= self._kth(part)[:, None])
            if not live.any():
                break       # bounds fall, so all later blocks are out too
            self.scored_blocks += int(live.sum())
            pending = [self._block(part.start, np.flatnonzero(live[:, b]), ids[cuts[b]:cuts[b] + BLOCK_ROWS],
                                   rows[cuts[b]:cuts[b] + BLOCK_ROWS], exact) for b in np.flatnonzero(live.any(0))]
            self._keep(*(np.concatenate(x) for x in zip(*pending)))
            done, step = done + step, step * 2

    def _kth(self, part) -> np.ndarray:
        """The k-th score so far, as a bound to reach; none where fewer are known."""
        return np.where(self.n[part] == self.k, self.score[part, -1].astype(np.float64), -np.inf)

    def _block(self, base: int, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
        """(query, score, id) of the block's rows that may be among the best of their query."""
        q = base + asking
        if exact:
            score = self.vectors[q] @ rows.T
        else:
            score = np.array([[min(max(sum(int(a) * int(b) for a, b in zip(x, y)), LONG.min + 1), LONG.max) for y in rows]
                              for x in self.vectors[q]], object)
        # A query never finds its own id.
        at = np.minimum(np.searchsorted(self.ids[q], ids), len(q) - 1)
        own = np.flatnonzero(self.ids[q][at] == ids)
        allowed = np.ones(score.shape, bool)
        allowed[at[own], own] = False
        if exact:
            score[~allowed] = -np.inf
            least = self._kth(q)
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
            allowed &= score >= least[:, None]
        i, j = np.nonzero(allowed)
        return q[i], score[i, j].astype(np.int64), ids[j]

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(q)
        filled = np.arange(self.k) < self.n[touched][:, None]
        q = np.concatenate([q, np.repeat(touched, self.n[touched])])
        score = np.concatenate([score, self.score[touched][filled]])
        ids = np.concatenate([ids, self.found[touched][filled]])
        # ~score falls as the score rises, and never overflows.
        order = np.lexsort((ids, ~score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, touched)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = place < self.k
        self.score[q[top], place[top]], self.found[q[top], place[top]] = score[top], ids[top]
        self.n[touched] = np.minimum(np.diff(np.append(first, len(q))), self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.ids), 4096):
            part = slice(lo, lo + 4096)
            filled = np.arange(self.k) < self.n[part][:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[part], self.n[part])), pa.array(self.found[part][filled]),
                                              pa.array(self.score[part][filled])], names=["query_id", "vec_id", "score"])


def _ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``PART_ROWS`` rows or one batch, in the order of the table."""
    ids, rows = [], []
    for batch in batches:
        if ids and sum(map(len, ids)) + batch.num_rows > PART_ROWS:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows = [], []
        ids.append(batch.column("vec_id").to_numpy())
        rows.append(padded(batch.column("v"), width, np.float64))
    if sum(map(len, ids)):
        yield np.concatenate(ids), np.concatenate(rows)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` greatest inner products of every query with the other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    # Beyond a long, a double is whole anyway.
    def floored(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(1e300)), F.lit(-1e300))
        return F.when(F.abs(y) < 2.0 ** 62, F.floor(y).cast("double")).otherwise(y)

    whole = F.transform("embedding", floored)
    kept = write_table(vectors.where(F.col("vec_id").isNotNull() & sound_vector(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")))
    asked = write_table(kept.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    width, n = kept.agg(F.max(F.size("v"))).first()[0] or 1, asked.count()
    slabs = -(-n * max(1, width) // SLAB_VALUES)
    folder = f"{shared_folder(spark)}/plumbline/{uuid.uuid4().hex}"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kind = "query_id long, vec_id long, score long"
    for i in range(max(1, slabs)):
        slab = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, slabs))) == i).toArrow().combine_chunks()
        order = np.argsort(slab.column("vec_id").to_numpy())
        queries = padded(slab.column("v").combine_chunks(), width, np.float64)[order] if slab.num_rows else np.empty((0, width))
        sent = spark.sparkContext.broadcast((slab.column("vec_id").to_numpy()[order], queries))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = Best(*sent.value, k)
            for ids, rows in _ranges(batches, width):
                found.meet(ids, rows)
            yield from found.rows()

        kept.mapInArrow(run, kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).write.parquet(f"{folder}/slab={i}")
        sent.unpersist()
    return spark.read.schema(kind + ", rank int").parquet(*[f"{folder}/slab={i}" for i in range(max(1, slabs))]).select("query_id", "rank", "vec_id", "score")


def op12(spark, folder):
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= {K}
"""
