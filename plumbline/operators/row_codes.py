"""Rows as short binary codes that are equal where the rows are, so that wide rows are moved, grouped and compared by one column.

A column of at most ``LEVELS`` distinct values takes one byte, the number of the value in a list made in one pass over all
rows. Any other column takes nine: one for null, eight for the value itself. Text that needs more room has its hash there and
stands in ``_texts`` besides. So equal codes and texts mean equal rows; no value is judged by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import INTEGRAL, MOMENTS, NESTED, micros, q, type_of
from plumbline.functions.tables import METHOD_LIMIT, setting, write_wide

LEVELS = 254          # distinct values of a column that takes one byte; 0 is null
LEVEL_CHARS = 64      # longer text is not listed
WIDE = 9              # bytes of a column with more values
CODES, TEXTS = "_codes", "_texts"


@dataclass(frozen=True)
class Layout:
    """Where the columns are in the codes; ``telling`` are the compared ones, those with most values first."""

    start: dict[str, int]
    wide: frozenset[str]
    texts: list[str]
    telling: list[str]
    exact: list[str] = field(default_factory=list)   # columns by which equal rows meet

    def width(self, col: str) -> int:
        return WIDE if col in self.wide else 1

    def piece(self, cols: list[str]) -> list[Column]:
        """The bytes of ``cols``; neighbours are cut out together."""
        spans: list[list[int]] = []
        for at, n in sorted((self.start[c], self.width(c)) for c in cols):
            if spans and sum(spans[-1]) == at:
                spans[-1][1] += n
            else:
                spans.append([at, n])
        return [F.substring(CODES, at + 1, n) for at, n in spans]


def _plain(df: DataFrame, col: str) -> tuple[str, Column]:
    """(long, double or text, the value as that)."""
    kind = type_of(df, col)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", q(col).cast("double")
    if isinstance(kind, (*INTEGRAL, T.BooleanType)):
        return "long", q(col).cast("long")
    if isinstance(kind, T.DateType):
        return "long", F.unix_date(q(col)).cast("long")
    if isinstance(kind, T.TimestampType):
        return "long", F.unix_micros(q(col))
    if isinstance(kind, MOMENTS):
        return "long", micros(q(col))
    return "text", F.hex(q(col)) if isinstance(kind, T.BinaryType) else q(col).cast("string")


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits of every value, is it there); 0.0 and -0.0 are one, and so are all NaN."""
    there = values.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(values.type):
        x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False) + 0.0
        return np.where(np.isnan(x), np.nan, x).view(np.int64), there
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False), there


def _levels(kinds: list[str]):
    """Function over batches: the distinct values of every column, or that it has too many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set | None] = [set() for _ in kinds]
        for batch in batches:
            for i, kind in enumerate(kinds):
                if seen[i] is None:
                    continue
                if kind == "text":
                    fresh = pc.unique(batch.column(i).drop_null())
                    if len(fresh) <= LEVELS and (pc.max(pc.utf8_length(fresh)).as_py() or 0) <= LEVEL_CHARS:
                        seen[i].update(fresh.to_pylist())
                    else:
                        seen[i] = None
                else:
                    x, there = _numbers(batch.column(i))
                    fresh = pc.unique(pa.array(x[there]))
                    if len(fresh) <= LEVELS:
                        seen[i].update(fresh.to_pylist())
                    else:
                        seen[i] = None
                if seen[i] is not None and len(seen[i]) > LEVELS:
                    seen[i] = None
        rows = [(i, k) for i, found in enumerate(seen) if found is not None for k in found]
        many = [i for i, found in enumerate(seen) if found is None]
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows] + many, pa.int32()),
            pa.array([None if kinds[i] == "text" else k for i, k in rows] + [None] * len(many), pa.int64()),
            pa.array([k if kinds[i] == "text" else None for i, k in rows] + [None] * len(many), pa.string()),
            pa.array([False] * len(rows) + [True] * len(many), pa.bool_())], ["c", "k", "t", "many"])

    return run


def _encode(n_kept: int, names: list[str], cells: list[tuple[int, str, list | None]]):
    """Function over batches: the kept columns as they are, and the codes."""
    length = sum(WIDE if levels is None else 1 for _, _, levels in cells)
    tables = [None if levels is None else pa.array(levels, pa.string()) if kind == "text" else np.array(levels, np.int64)
              for _, kind, levels in cells]

    def codes(batch: pa.RecordBatch) -> pa.Array:
        n = batch.num_rows
        out = np.zeros((n, length), np.uint8)
        for i, ((at, kind, _), table) in enumerate(zip(cells, tables, strict=True)):
            values = batch.column(n_kept + i)
            if table is not None and kind == "text":
                found = pc.fill_null(pc.index_in(values, value_set=table), -1).to_numpy(zero_copy_only=False) + 1
                lost = (found == 0) & values.is_valid().to_numpy(zero_copy_only=False)
                out[:, at] = found
            elif table is not None:
                x, there = _numbers(values)
                found = np.searchsorted(table, x)
                lost = there if not len(table) else there & (table[np.minimum(found, len(table) - 1)] != x)
                out[:, at] = np.where(there, found + 1, 0)
            else:
                x, there = _numbers(values)
                out[:, at] = there
                out[:, at + 1:at + WIDE] = x.astype("<i8").view(np.uint8).reshape(n, 8)
                continue
            if lost.any():
                raise ValueError("the rows changed while they were read")
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * length)
        return pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], codes(batch)], names)

    return run


def encode_rows(df: DataFrame, keep: list[str], keys: list[str], compare: list[str], parts: int) -> tuple[DataFrame, Layout]:
    """(``keep`` columns with the codes of ``keys`` and ``compare``, the layout).

    The compared columns are dealt out so that each of ``parts`` parts has telling ones and its bytes stand together.
    """
    cols = [*keys, *compare]
    plain = {c: _plain(df, c) for c in cols}
    kinds = [plain[c][0] for c in cols]
    found = write_wide(df.select(*[plain[c][1].alias(f"_v{i}") for i, c in enumerate(cols)]).mapInArrow(
        _levels(kinds), "c int, k long, t string, many boolean").distinct())
    sizes = {r.c: r for r in found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).collect()}
    wide = {c for i, c in enumerate(cols) if i in sizes and (sizes[i].many or sizes[i].n > LEVELS)}
    listed: dict[str, list] = {c: [] for c in cols if c not in wide}
    for r in found.where(F.col("c").isin([i for i, c in enumerate(cols) if c not in wide])).collect() if listed else []:
        listed[cols[r.c]].append(r.t if kinds[r.c] == "text" else r.k)
    listed = {c: sorted(levels) for c, levels in listed.items()}

    open_ = [c for c in compare if c in wide]
    n_values = {c: len(listed[c]) for c in compare if c not in wide}
    if len(open_) > 1:
        with setting(df.sparkSession, METHOD_LIMIT, "8000"):
            n_values |= dict(zip(open_, df.agg(*[F.approx_count_distinct(q(c), 0.1).alias(f"d{i}") for i, c in enumerate(open_)]).first()))
    telling = sorted(compare, key=lambda c: -n_values.get(c, LEVELS + 1))
    start, at = {}, 0
    for c in [*keys, *[c for part in range(parts) for c in telling[part::parts]]]:
        start[c] = at
        at += WIDE if c in wide else 1
    order = list(start)
    texts = [c for c in order if c in wide and plain[c][0] == "text"]
    given = [F.xxhash64(plain[c][1]) if c in texts else plain[c][1] for c in order]
    given = [F.when(plain[c][1].isNotNull(), v) if c in texts else v for c, v in zip(order, given)]
    kept = [q(c) for c in keep] + ([F.array(*[plain[c][1] for c in texts]).alias(TEXTS)] if texts else [])
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(CODES, T.BinaryType())])
    cells = [(start[c], plain[c][0], listed.get(c)) for c in order]
    coded = df.select(*kept, *[v.alias(f"_v{i}") for i, v in enumerate(given)]).mapInArrow(
        _encode(len(kept), schema.names, cells), schema)
    nested = [c for c in cols if c in keep and isinstance(type_of(df, c), NESTED)]
    return coded, Layout(start, frozenset(wide), texts, telling, [CODES, *([TEXTS] if texts else []), *nested])


class Cells:
    """The codes of some rows as arrays: a byte or a number for every column, by row."""

    def __init__(self, layout: Layout, cols: list[str], rows: pa.Table, order: np.ndarray):
        n = rows.num_rows
        codes = rows.column(CODES).combine_chunks()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + n + 1]
        matrix = np.frombuffer(codes.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(n, -1)[order]
        wide = [c for c in cols if c in layout.wide]
        self.narrow = np.ascontiguousarray(matrix[:, [layout.start[c] for c in cols if c not in layout.wide]])
        self.there = np.ascontiguousarray(matrix[:, [layout.start[c] for c in wide]])
        self.values = np.empty((n, len(wide)), np.int64)
        for i, c in enumerate(wide):
            at = layout.start[c] + 1
            self.values[:, i] = np.ascontiguousarray(matrix[:, at:at + WIDE - 1]).view("<i8")[:, 0]
        if any(c in layout.texts for c in wide):
            # Texts are numbered as they occur here; their hashes decide nothing.
            flat = rows.column(TEXTS).combine_chunks()
            flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().dictionary_encode()
            numbers = pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False).reshape(n, -1)[order]
            for i, c in enumerate(wide):
                if c in layout.texts:
                    self.values[:, i] = numbers[:, layout.texts.index(c)]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many columns rows ``a`` differ from rows ``b``."""
        found = np.count_nonzero(self.narrow[a] != self.narrow[b], axis=1) if self.narrow.shape[1] else np.zeros(len(a), np.int64)
        if self.values.shape[1]:
            found = found + np.count_nonzero((self.values[a] != self.values[b]) | (self.there[a] != self.there[b]), axis=1)
        return found
