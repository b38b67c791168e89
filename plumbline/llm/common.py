"""Small helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts: the blank and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit numbers (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a batch of texts: ``code`` per word into ``names``, ``ends`` per text (as offsets, first 0)."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        pieces = pc.ascii_split_whitespace(texts)
        flat, offsets = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        self.names = coded.dictionary
        before = np.concatenate([[0], np.cumsum(full)])
        self.ends = before[offsets].astype(np.int64)
        self.code = coded.indices.to_numpy(zero_copy_only=False)[full]
        self.count = np.diff(self.ends)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every distinct word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.names.cast(pa.large_binary()).to_pylist()),
                           np.uint64, len(self.names))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text (a longer text is a batch of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(size, base + most_bytes, side="right"))))
            # A copy: kernels on string lists misread the offsets of a slice.
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop
        del batch, size
        # Workers are reused for hours; what a large batch took goes back at once.
        pa.default_memory_pool().release_unused()


def sound_vector(vector: Column) -> Column:
    """Is the vector there, without null or non-finite components?"""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def padded(lists: pa.ListArray, width: int, kind) -> np.ndarray:
    """The lists as rows of a matrix, filled up with zeros to ``width``; they hold no nulls."""
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]] if len(lists) else np.empty(0)
    n = np.diff(ends)
    if (n == width).all():
        return values.reshape(len(lists), width).astype(kind)
    out = np.zeros((len(lists), width), kind)
    out[np.arange(width) < n[:, None]] = values
    return out
