"""Vector code compression: product codes whose nearest entries come from memoised grid cells.

Every component becomes the integer floor(scale * x). Vectors are cut into equal parts; each part position has a codebook
that starts as that part of the vectors with the smallest ids and is moved to the means of its parts in every round.

An entry is the nearest of some point in a coarse grid cell only if its least distance to the cell's box is not above the
smallest greatest distance of any entry. Each task remembers, by a hash of the cell, which entries pass that test, and
evaluates exactly those for the parts in the cell. Entries that tie are never ruled out, so the codes are those of a full
search. Only sums per (part, entry, position) leave the tasks during training: a table of fixed size.

Rules for edge cases: a vector that is null or holds null or non-finite components is dropped; vectors shorter than the
longest one, or of a length that the number of parts doesn't divide, count as padded with zeros at the end; components are
held within +-2^27 after scaling; a row without id is coded but never starts a codebook; rows that repeat an id are coded
each on its own, and the rows with the smallest (id, vector) start the codebooks; with fewer rows than entries the codebooks
are shorter; an empty table gives an empty result; ``label`` values that are null share one sum; a sum of errors beyond a
long is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm.common import mix64, padded, sound_vector, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 27            # scaled components are held within this, so that squared distances fit a long
CACHED_CELLS = 1 << 15    # cells a task remembers per part; what comes beyond is worked out each time
_ODD = np.uint64(0x9E3779B97F4A7C15)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as integers."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))


class Cells:
    """Nearest entries of one part position, by way of the cells of a coarse grid."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        # Boxes about a third as wide, corner to corner, as entries lie apart: few entries pass, and cells recur.
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        gap = np.median(np.sqrt(apart.min(1))) if len(entries) > 1 else 1.0
        edge = gap / (3 * max(1.0, entries.shape[1]) ** 0.5)
        self.shift = int(np.log2(edge)) if edge > 1 else 0
        self.keys = np.empty(0, np.uint64)
        self.corners = np.empty((0, entries.shape[1]), np.int64)
        self.allowed = np.empty((0, len(entries)), bool)
        self.worked_out = 0

    def allow(self, corners: np.ndarray) -> np.ndarray:
        """(cells, entries): may the entry be the nearest of a point in the cell?"""
        out = np.empty((len(corners), len(self.entries)), bool)
        self.worked_out += len(corners)
        for lo in range(0, len(corners), 4096):
            low = (corners[lo:lo + 4096] << self.shift)[:, None]
            below, above = low - self.entries, self.entries - (low + (1 << self.shift) - 1)
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            out[lo:lo + 4096] = (least * least).sum(2) <= (most * most).sum(2).min(1, keepdims=True)
        return out

    def of(self, parts: np.ndarray) -> np.ndarray:
        """``allow`` for the cell of every row of ``parts``, from memory where it is there."""
        corners = parts >> self.shift
        keys = np.full(len(parts), _ODD)
        for j in range(corners.shape[1]):
            keys = mix64(keys + corners[:, j].astype(np.uint64)) * _ODD
        seen, first, back = np.unique(keys, return_index=True, return_inverse=True)
        own = corners[first]
        at = np.minimum(np.searchsorted(self.keys, seen), max(0, len(self.keys) - 1))
        taken = self.keys[at] == seen if len(self.keys) else np.zeros(len(seen), bool)
        hit = taken.copy()
        if len(self.keys):
            hit &= (self.corners[at] == own).all(1)
        allowed = np.empty((len(seen), len(self.entries)), bool)
        allowed[hit] = self.allowed[at[hit]]
        allowed[~hit] = self.allow(own[~hit])
        new = np.flatnonzero(~taken)[:CACHED_CELLS - len(self.keys)]
        if len(new):
            self.keys = np.concatenate([self.keys, seen[new]])
            order = np.argsort(self.keys)
            self.keys = self.keys[order]
            self.corners = np.concatenate([self.corners, own[new]])[order]
            self.allowed = np.concatenate([self.allowed, allowed[new]])[order]
        out = allowed[back]
        # Two cells of a batch with one hash: all entries are evaluated.
        out[(corners != own[back]).any(1)] = True
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row; ties to the lower index."""
        allowed = self.of(parts)
        code = np.zeros(len(parts), np.int64)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            at = np.flatnonzero(allowed[:, e])
            apart = parts[at] - entry
            apart = (apart * apart).sum(1)
            closer = apart < best[at]
            code[at[closer]], best[at[closer]] = e, apart[closer]
        return code, best


def _coded(batch: pa.RecordBatch, cells: list[Cells], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part vectors, codes, squared distances) per part position."""
    rows = padded(batch.column("v"), width * len(cells), np.int64)
    for p, memo in enumerate(cells):
        part = np.ascontiguousarray(rows[:, p * width:(p + 1) * width])
        yield part, *memo.nearest(part)


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: componentwise floor of the mean of each entry's parts."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for p, (part, code, _) in enumerate(_coded(batch, cells, width)):
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, part)
        at = np.flatnonzero(np.repeat(count.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at]), pa.array(np.repeat(count.ravel(), width)[at])],
                                         names=["at", "total", "n"])

    # A row per part, entry and position at most.
    got = kept.select("v").mapInArrow(sums, "at long, total long, n long").groupBy("at").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.copy().ravel()
    at, total, n = (got.column(c).to_numpy() for c in ("at", "total", "n"))
    out[at] = total // n
    return out.reshape(books.shape)


def train(kept: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) over all rows of ``kept`` (``vec_id``, ``v``: scaled vectors)."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.empty((parts, 0, 0), np.int64)
    width = -(-longest // parts)
    # As many rows as a codebook has entries.
    first = kept.where("vec_id IS NOT NULL").select("vec_id", "v").orderBy("vec_id", "v").limit(entries).toArrow()
    start = padded(first.column("v").combine_chunks(), width * parts, np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    if books.size:
        for _ in range(rounds):
            books = _moved(kept, books)
    return books


def codes(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` rows as ``vec_id``, ``label``, ``code`` (two hex digits per part), ``error``."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    width = books.shape[2]
    digits = np.array([f"{i:02x}".encode() for i in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            code, error = [], np.zeros(batch.num_rows, np.int64)
            for _, c, e in _coded(batch, cells, width):
                code.append(digits[c])
                error += e
            text = np.ascontiguousarray(np.column_stack(code)).view(f"S{2 * len(books)}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text.tolist(), pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``label``, ``code``, ``error`` of every sound row; codebooks) of ``vec_id``, ``embedding``, ``label``."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits holds 1 to 256 entries")
    kept = write_table(vectors.where(sound_vector(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), scale).alias("v")))
    books = train(kept, parts, entries, rounds)
    if not books.size:
        # No vector, none with an id, or none with a component: nothing to tell apart.
        return kept.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.aggregate(
            "v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x).alias("error")), books
    return codes(kept, books), books


def op11(spark, folder):
    coded, books = compress(table(spark, folder, "embeddings"))
    coded = write_table(coded)
    # One row per label; adaptive execution splits the rows of a frequent one, or sends the sums where they are few.
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")), "left").select(
        "c.vec_id", "c.code", "c.error", "s.label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a list per vector, the rounds written out."""
    part = f"FROM k, range({PARTS}) p(p)"
    ctes = [f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"x AS (SELECT vec_id, label, p, v[p * w + 1:(p + 1) * w] AS x {part})",
            f"""b0 AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM x
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"""]
    apart = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e
  FROM (SELECT vec_id, label, x.p, x, e, {apart} AS d FROM x JOIN b{r} USING (p)) GROUP BY vec_id, label, p)""")
        if r < ROUNDS:
            ctes.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS m FROM (
  SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(w) FROM k) + 1) t(i) GROUP BY ALL)) GROUP BY p, e)""")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return "WITH " + ",\n".join(ctes) + f""",
c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


SQL = _sql()
