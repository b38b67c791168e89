"""Source divergence audit: how the smoothed term frequencies of sources differ, pair by pair and term by term.

A lang keeps the terms that occur in enough of its documents. A group (a source of a lang, or the whole lang) gives every kept
term p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), V kept terms with N occurrences in the group. Two groups differ at a
term by f = floor((p - q)^2 / (p + q)).

p depends on a term only by its count, so pairs need no row per term. Kept terms are dealt to chunks by hash and numbered
there; a chunk stores one bitset of term numbers per (group, count). The bits that two bitsets share, counted, are a joint
cell of the pair, to be multiplied by the cell's f. Terms that a group lacks are the complement: what a count's bits
don't share with any bitset of the other group meets its zero, and what neither group has meets zero with zero. Chunks are
cut so that each holds a bounded number of (term, source) cells; only sums per pair leave it.

Rules for edge cases: null ``text``, ``lang`` and ``source`` count as empty strings; every (lang, source) that occurs is a
group, also without terms or kept terms (its pairs then have the values that the zeros give, 0 where the lang keeps none); a
lang with one source has no pairs; ties go to the smaller item in UTF-8; repeated rows count each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm.common import slices, table

LEAST_DOCUMENTS, TOP, ONE = 10, 10, 1_000_000_000
CHUNK_CELLS = 4096        # (term, source) cells of a chunk, about
BATCH_BYTES = 8 << 20     # of text that a task counts at once
# Byte by byte: letters of ASCII in lower case, bytes of other characters as they are, all else a blank.
_LETTERS = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, code of every term in order, its text)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    clean = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_LETTERS[data])])
    # Not a check, as the bytes were text before.
    pieces = pc.ascii_split_whitespace(clean.view(pa.large_string()))
    flat = pieces.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[full], pc.list_parent_indices(pieces).to_numpy()[full]


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``df`` (documents); and a row per group with a null term."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            names, term, doc = _terms(batch.column("text"))
            lang, source = (batch.column(c).cast(pa.large_string()).dictionary_encode() for c in ("lang", "source"))
            n_sources, width = len(source.dictionary), max(1, len(names))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources + source.indices.to_numpy(zero_copy_only=False)
            # Occurrences per (document, term) first, from which both counts follow.
            cell, n = np.unique(doc.astype(np.int64) * width + term, return_counts=True)
            cell, at = np.unique(group[cell // width] * width + cell % width, return_inverse=True)
            there = np.unique(group)
            owner, more = np.concatenate([cell // width, there]), np.zeros(len(there), np.int64)
            out = pa.table({
                "lang": lang.dictionary.take(pa.array(owner // n_sources)), "source": source.dictionary.take(pa.array(owner % n_sources)),
                "term": pa.chunked_array([names.take(pa.array(cell % width)), pa.nulls(len(there), names.type)]),
                "n": np.concatenate([np.bincount(at, n, len(cell)).astype(np.int64), more]),
                "df": np.concatenate([np.bincount(at, minlength=len(cell)).astype(np.int64), more])}).cast(kind).combine_chunks()
            yield from out.to_batches(max_chunksize=1 << 16)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(count, "lang string, source string, term string, n long, df long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def weight(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in a group with ``total`` occurrences of the ``kept`` terms; null where no term is kept."""
    parts = F.nullif(total.cast("decimal(20,0)") + 2 * kept.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", (count.cast("decimal(20,0)") + 2) * F.lit(ONE).cast("decimal(10,0)"), parts) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bits(number: np.ndarray, row: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bitsets: row ``row[i]`` has bit ``number[i]``."""
    out = np.zeros(shape, np.uint64)
    np.bitwise_or.at(out, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    return out


def pair_sums(source: np.ndarray, count: np.ndarray, p: np.ndarray, number: np.ndarray, n_sources: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one source, the other, sum of f over the terms of a chunk), each unordered pair once.

    A row is a (term, source) cell: its source, its count, the p of that count and the term's number; rows with count 0 and
    number -1 carry the p of the sources' zeros, one per source at least.
    """
    zero = np.zeros(n_sources, np.int64)
    zero[source[count == 0]] = p[count == 0]
    there = count > 0
    source, count, p, number = source[there], count[there], p[there], number[there]
    terms = int(number.max()) + 1 if len(number) else 0
    # Levels: one per (source, count), in that order.
    order = np.lexsort((count, source))
    source, count, p, number = source[order], count[order], p[order], number[order]
    fresh = np.append(True, (source[1:] != source[:-1]) | (count[1:] != count[:-1])) if len(source) else np.zeros(0, bool)
    level = np.cumsum(fresh) - 1
    own, weight_of = source[fresh], p[fresh]
    bits = _bits(number, level, (len(own), -(-max(terms, 1) // 64)))
    held = np.bincount(level, minlength=len(own))
    start = np.searchsorted(own, np.arange(n_sources + 1))
    per_source = np.bincount(source, minlength=n_sources)

    def f(a, b):
        return (a - b) * (a - b) // (a + b)

    left, right, value = [], [], []
    for g in range(n_sources - 1):
        a, b = start[g], start[g + 1]
        others, later = np.arange(g + 1, n_sources), slice(b, len(own))
        total = np.zeros(n_sources, np.int64)
        joint_of = np.zeros(n_sources, np.int64)
        mine = np.repeat(held[a:b, None], n_sources, axis=1)     # terms of each level of g that the others lack
        lacked = held[later].copy()                              # terms of their levels that g lacks
        for at in range(a, b, 64):
            some = slice(at, min(b, at + 64))
            joint = np.bitwise_count(bits[some, None] & bits[None, later]).sum(2, dtype=np.int64)
            i, j = np.nonzero(joint)
            n, s = joint[i, j], own[later][j]
            np.add.at(total, s, n * f(weight_of[some][i], weight_of[later][j]))
            np.subtract.at(mine, (i + at - a, s), n)
            np.add.at(joint_of, s, n)
            lacked -= joint.sum(0)
        total[others] += (mine[:, others] * f(weight_of[a:b, None], zero[None, others])).sum(0) if b > a else 0
        np.add.at(total, own[later], lacked * f(zero[g], weight_of[later]))
        neither = terms - per_source[g] - per_source[others] + joint_of[others]
        if terms:
            total[others] += neither * f(zero[g], zero[others])
        left.append(np.full(len(others), g))
        right.append(others)
        value.append(total[others])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(value)


def _pairs(key: tuple, rows: pa.Table) -> pa.Table:
    coded = rows.column("source").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary
    a, b, value = pair_sums(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), *[
        rows.column(c).to_numpy() for c in ("n", "p", "number")], len(names))
    one, two = names.take(pa.array(a)), names.take(pa.array(b))
    return pa.table({"lang": pa.repeat(key[0].cast(pa.string()), len(a)), "source": one, "item": two, "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``; see the module."""
    counts = write_table(term_counts(docs))
    groups = counts.where("term IS NULL").select("lang", "source")
    per_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"), F.count(F.lit(1)).alias("k"))
    kept = write_table(per_term.where(F.col("df") >= least_documents).drop("df"))
    # A row per lang.
    langs = write_table(groups.select("lang").distinct().join(kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"), F.sum("k").alias("cells")), "lang", "left").na.fill(0).withColumn(
        "chunks", F.greatest(F.lit(1), F.ceil(F.col("cells") / CHUNK_CELLS))))
    numbered = W.partitionBy("lang", "chunk").orderBy("term")
    terms = write_table(kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn(
        "number", F.row_number().over(numbered) - 1).select(
        "lang", "term", "chunk", "number", weight(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")))
    cells = write_table(counts.where("term IS NOT NULL").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "q", "chunk", "number"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = write_table(groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs.select("lang", "kept", "chunks"), "lang"))
    # p once per (source, count), then on every cell; the groups' zeros go to each chunk of their lang.
    levels = cells.join(stats, ["lang", "source"]).select(
        "lang", "source", "term", "q", "chunk", "number", "n", weight(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    levels = write_table(levels)
    zeros = stats.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).alias("number"),
                         F.lit(0).cast("long").alias("n"), F.coalesce(weight(F.lit(0), F.col("total"), F.col("kept")), F.lit(1)).alias("p"))
    dealt = levels.select("lang", "source", "chunk", "number", "n", "p").unionByName(zeros)
    sums = write_table(dealt.groupBy("lang", "chunk").applyInArrow(_pairs, "lang string, source string, item string, value long").groupBy(
        "lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum("value").alias("value")))
    pairs = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = levels.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).unionByName(
        best.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13(spark, folder):
    return audit(table(spark, folder, "documents"))


_P = f"1 + ({ONE}::HUGEINT * (n + 2)) // (total + 2 * kept)"
SQL = f"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS kept, sum(n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, v.kept, v.lang_total,
  sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, {_P} AS p, {_P.replace('(n + 2)', '(lang_n + 2)').replace('total', 'lang_total')} AS q FROM cells),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
