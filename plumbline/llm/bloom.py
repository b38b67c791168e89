"""Blocked Bloom filter as a table: one row per 256-bit block, built and probed with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BLOCK_BITS = 256
# A filter of at most so many blocks (32 bytes each, so 16 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 1 << 19


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its mask in each of the block's four words: two bits a word from six hash bits each."""
    bits = F.xxhash64(key, F.lit(11))
    masks = []
    for word in range(4):
        first, second = (F.shiftrightunsigned(bits, 12 * word + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1))
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), first).bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), second)))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def build(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(filter table, number of blocks) over the distinct values of ``key``."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    block, masks = _place(F.col(key), blocks)
    return listed.select(block.alias("_block"), *[m.alias(f"_m{i}") for i, m in enumerate(masks)]).groupBy("_block").agg(
        *[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(4)]), blocks


def probe(rows: DataFrame, key: str, built: tuple[DataFrame, int], flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where ``key`` is certainly not listed (or null)."""
    words, blocks = built
    block, masks = _place(F.col(key), blocks)
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    met = F.lit(True)
    for i, m in enumerate(masks):
        met = met & (F.col(f"_w{i}").bitwiseAND(m) == m)
    return rows.withColumn("_block", block).join(words, "_block", "left").withColumn(
        flag, F.coalesce(met & F.col(key).isNotNull(), F.lit(False))).drop("_block", *[f"_w{i}" for i in range(4)])
