"""Best-fit packing: token pieces into sequences of a fixed length, exact complements first.

Rules for edge cases: a null text is empty and packs as its end mark alone; a text of any length is cut into full pieces
behind a first, shorter one; repeated rows (and null ids) pack each on their own, in any order among themselves; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm.common import slices, table

LENGTH, END_ID = 2048, 0
SPECIAL = "<|endoftext|>"
# Texts of characters below this code point take the fast encoder over the same vocabulary; both agree there (tested).
PLAIN_BELOW = 0x250


class Encoder:
    """Token ids of the public byte-level vocabulary, as ``tokenizers`` gives them.

    Encoding is all the work here, and the other public library over the same ranks is four times as fast. It encodes
    texts in plain Latin characters without a special token; the rest goes through ``tokenizers``.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text and (text.isascii() or max(map(ord, text)) < PLAIN_BELOW):
            return self.plain.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cut(docs: DataFrame, length: int = LENGTH, with_ids: bool = True, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text"):
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = np.array([*encode.ids(text or ""), END_ID], dtype="<u4")
                first = len(got) % length or length
                for k, lo in enumerate([0, *range(first, len(got), length)]):
                    part = got[lo:first if k == 0 else lo + length]
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            cols = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


class SumIndex:
    """How many pieces of each length are left, and which sums up to ``length`` one, two or three of them make.

    ``pairs[s]`` counts the pairs of lengths at hand that add up to s; it is kept up to date as lengths run out. A triple with
    the sum s exists where, for some length a, a pair adds up to s - a.
    """

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.length = length
        self.left = np.zeros(length + 1, np.int64)
        for size, n in counts.items():
            self.left[size] += n
        self.left[0] = 0
        self.pairs = np.zeros(length + 1, np.int64)
        there = np.flatnonzero(self.left)
        for i, a in enumerate(there):
            sums = a + there[i + (self.left[a] < 2):]
            self.pairs[sums[sums <= length]] += 1

    def take(self, size: int, n: int = 1) -> None:
        before, after = self.left[size], self.left[size] - n
        if before >= 2 > after and 2 * size <= self.length:
            self.pairs[2 * size] -= 1
        self.left[size] = after
        if not after:
            sums = size + np.flatnonzero(self.left)
            self.pairs[sums[sums <= self.length]] -= 1

    def _pair(self, left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths of ``left`` that add up to ``total``, the larger as large as can be but at most ``most``."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        ok = a[(left[a] > 0) & (left[total - a] > (2 * a == total))]
        return (int(ok[0]), total - int(ok[0])) if len(ok) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths at hand that fill ``gap`` exactly; None only if there are none."""
        if self.left[gap]:
            return (gap,)
        if self.pairs[gap] and (found := self._pair(self.left, gap, gap)):
            return found
        a = np.arange(gap - 2, 0, -1)
        for first in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            self.left[first] -= 1
            found = self._pair(self.left, gap - first, first)
            self.left[first] += 1
            if found:
                return (first, *found)
        return None

    def longest(self, most: int) -> int | None:
        fits = np.flatnonzero(self.left[:most + 1])
        return int(fits[-1]) if len(fits) else None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths, how often): a bounded list, since each uses up some length.

    From the longest length down, the gap it leaves is filled exactly where one, two or three lengths at hand add up to it.
    What fits nothing exactly takes the longest piece that fits (best fit), and the smaller gap is looked up anew.
    """
    index = SumIndex(counts, length)
    out: list[tuple[tuple[int, ...], int]] = []
    for size in range(length, 0, -1):
        while index.left[size]:
            index.take(size)
            pattern, gap = [size], length - size
            while gap:
                fill = index.exact(gap)
                if fill is None:
                    best = index.longest(gap)
                    if best is None:
                        break
                    fill = (best,)
                for s in fill:
                    index.take(s)
                    pattern.append(s)
                    gap -= s
            # The same sequence again as often as every length in it lasts.
            need = np.bincount(pattern, minlength=length + 1)
            more = int((index.left[need > 0] // need[need > 0]).min())
            if more:
                for s in np.flatnonzero(need).tolist():
                    index.take(s, more * int(need[s]))
            out.append((tuple(pattern), 1 + more))
    return out


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (a written table with ``length``) with ``sequence_id`` and ``offset``.

    The plan is made from the counts per length (at most ``length`` numbers). Pieces of a length are then numbered: in
    each range partition, plus the counts of earlier partitions; number r of a length takes the r-th slot of that length.
    """
    order = ["length", "_spread", "doc_id", "piece"]
    placed = write_table(pieces.withColumn("_spread", F.xxhash64("doc_id", "piece")).repartitionByRange(*order).withColumn(
        "_chunk", F.spark_partition_id()))
    parts = write_table(placed.groupBy("_chunk", "length").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("_n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    used: dict[int, int] = {}
    for pattern, times in plan(counts, length):
        offset = 0
        for s in pattern:
            slots.setdefault(s, []).append((used.get(s, 0), base, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        base += times
    tables = {s: np.array(v, np.int64).T for s, v in slots.items()}
    carried = parts.select("_chunk", "length", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_chunk").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    inside = W.partitionBy("_chunk", "length").orderBy("_spread", "doc_id", "piece")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1).join(carried, ["_chunk", "length"]).withColumn(
        "_rank", (F.col("_rank") + F.col("_carry")).cast("long")).select(*pieces.columns, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                first, start, offset = tables[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = start[k] + rank[at] - first[k], offset[k]
            cols = [batch.column(c) for c in pieces_columns] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=[*pieces_columns, "sequence_id", "offset"])

    pieces_columns = pieces.columns
    return ranked.mapInArrow(seat, schema)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Where every piece of every document lies: ``doc_id piece start length ids_crc32 sequence_id offset``."""
    return place(write_table(cut(docs, length, False, tokenizer)), length)


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """The packed training rows: ``sequence_id``, ``ids`` (at most ``length``), ``doc_ids``."""
    seated = place(write_table(cut(docs, length, True, tokenizer)), length)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return seated.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op4(spark, folder):
    return pack(table(spark, folder, "documents"))
