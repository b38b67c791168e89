"""N-gram Jaccard join: near copies by grouped prefixes of shingle sets, and the components that the links form.

A document's set is its distinct 5-word shingles (A-Z lower-cased), as 64-bit hashes; with one to four words the whole
sequence is its only shingle. Two sets link when intersection / union is at least 0.75. Rules for edge cases: null, empty
and blank texts have an empty set and are linked with nothing; equal sets always link; rows that repeat an id count as one
document, so they share a component; a row without id links with nothing and has a null component; an empty table gives an
empty result; other columns are ignored.

Steps, each over all rows:

1. Frequent shingles. Map tasks count shingles and report those they see twice; the most frequent ones become a list of
   bounded size. It only puts them last in the order of a set, which keeps prefixes selective; results don't depend on it.
2. Grouped prefixes. A set's prefix is so long that linked sets share a shingle in it. Documents with identical prefix
   and size form one group. (shingle, group) pairs meet per shingle in packed buckets; shingles of one group go away,
   those on the frequent list are never gathered in one task.
3. Star links. Per shingle every set is compared with one centre only, so groups of copies of any size cost a line, not a
   square. Pairs are filtered by size and by the shingles that their prefixes share, then verified on whole sets; links
   give components; a second round uses other centres.
4. The rest. Where a shingle still joins sets of different components, those outside the largest component meet the
   others, filtered and verified alike. The members of a shingle meet in blocks of a bounded size, many blocks to a task,
   and a pair that shares many shingles leaves a task once.

Every set also has a parity sketch of 512 bits: bit i is the parity of its shingles that hash to i. The bits in which two
sketches differ are at most the shingles in which the sets differ, and linked sets differ in a seventh of their added sizes
at most, so the sketches rule out pairs before anything else is compared, and never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm import bloom
from plumbline.llm.common import Words, mix64, slices, table

WORDS = 5
FREQUENT = 4            # a shingle seen so often (in tasks that see it twice) may enter the list
BATCH_BYTES = 2 << 20    # of text that a task works on at once
LIST_SIZE = 1 << 20      # and at most so many do: 12 MB of hashes and ranks, sent to every task
BUCKET_BYTES = 8 << 20   # of packed pairs that meet in one group, about
BLOCK_MEMBERS = 512      # of a shingle's members that meet each other in one block
BLOCK_ROWS = 1 << 17     # rows of blocks that one task works on, about
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, offsets per text)."""
    words = Words(texts, lower=True)
    h = words.hashes()[words.code] if len(words.code) else np.empty(0, np.uint64)
    out, ends = [], np.zeros(len(words.count) + 1, np.int64)
    wide = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        wide += h[j:j + len(wide)] * _STEP[j]
    wide = mix64(wide)
    for i, (lo, hi) in enumerate(zip(words.ends[:-1].tolist(), words.ends[1:].tolist())):
        n = hi - lo
        if n >= WORDS:
            got = np.sort(wide[lo:hi - WORDS + 1])
            fresh = got[1:] != got[:-1]
            if not fresh.all():
                got = got[np.concatenate([[True], fresh])]
            out.append(got)
            ends[i + 1] = len(got)
        elif n:
            out.append(mix64(np.array([(h[lo:hi] * _STEP[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
            ends[i + 1] = 1
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(ends)


def prefix_length(n):
    return n - (3 * n + 3) // 4 + 1


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum (wrapping) of ``values[start:end]`` for every pair; 0 where it is empty."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ends] - total[starts]


def _rare_first(hashes: np.ndarray, ends: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets with the listed shingles moved behind the others, the least frequent first; and which are listed."""
    listed, rank = frequent
    if not len(listed) or not len(hashes):
        return hashes, np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    hit = listed[at] == hashes
    if hit.any():
        hashes, moved = hashes.copy(), hit.copy()
        count = np.concatenate([[0], np.cumsum(hit)])
        for i in np.flatnonzero(count[ends[1:]] > count[ends[:-1]]).tolist():
            lo, hi = ends[i], ends[i + 1]
            m = hit[lo:hi]
            own = hashes[lo:hi]
            last = own[m][np.argsort(rank[at[lo:hi][m]])]
            hashes[lo:hi] = np.concatenate([own[~m], last])
            moved[lo:hi] = np.arange(hi - lo) >= hi - lo - len(last)
        hit = moved
    return hashes, hit


def _sketches(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The words of the sets' parity sketches, one array over all sets per word."""
    full = n > 0
    word, bit = (hashes >> np.uint64(6)) & np.uint64(7), np.uint64(1) << (hashes & np.uint64(63))
    for w in range(len(SKETCH)):
        out = np.zeros(len(n), np.uint64)
        if full.any():
            out[full] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), starts[full])
        yield out.view(np.int64)


def _sketch_allows(a: str, b: str, n: str, m: str) -> Column:
    """May sets of sizes ``n`` and ``m`` link, by their sketches (columns prefixed ``a`` and ``b``)? Null sketches: yes."""
    apart = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH[1:]),
                F.bit_count(F.col(a + SKETCH[0]).bitwiseXOR(F.col(b + SKETCH[0]))))
    return F.coalesce(7 * apart <= F.col(n) + F.col(m), F.lit(True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def frequent_shingles(docs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """((sorted hashes, rank by frequency) of the list, number of shingles of all sets together)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty(0, np.uint64), np.empty(0, np.int64)
        total = 0
        for batch in slices(batches, "text", BATCH_BYTES):
            values = np.sort(shingle_sets(batch.column("text"))[0])
            total += len(values)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(values)))
            twice = n > 1
            values, at = np.unique(np.concatenate([kept[0], values[first[twice]]]), return_inverse=True)
            kept = values, np.bincount(at, np.concatenate([kept[1], n[twice]]), len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([_signed(kept[0]), pa.array(kept[1], pa.int64())], names=["shingle", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["shingle", "n"])

    counts = write_table(docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(
        F.col("shingle").isNull() | (F.col("n") >= FREQUENT)))
    total = counts.where("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    # The least frequency that keeps the list within its size; frequencies beyond a bound count as one.
    top = 1 << 16
    sizes = dict(counts.where("shingle IS NOT NULL").groupBy(F.least("n", F.lit(top)).alias("n")).count().collect())
    least, room = top, LIST_SIZE
    for n in sorted(sizes, reverse=True):
        room -= sizes[n]
        if room < 0:
            break
        least = n
    listed = counts.where("shingle IS NOT NULL").where(F.col("n") >= least).limit(LIST_SIZE).toArrow()
    values = np.ascontiguousarray(listed.column("shingle").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[np.lexsort((values[order], listed.column("n").to_numpy()[order]))] = np.arange(len(values), dtype=np.int32)
    return (values[order], rank), total


# A shingle and a group travel as the upper 48 bits of their hashes: at most a few more candidates come of it, since pairs
# are verified on whole sets. ``at`` is the place of the shingle in the set, in 65536ths, rounded down.
_PAIR = np.dtype([("shingle", "<u4"), ("shingle_low", "<u2"), ("group", "<u4"), ("group_low", "<u2"), ("at", "<u2")])
SKETCH = [f"x{i}" for i in range(8)]    # columns of the sketch, 64 bits each
_KEYS = np.dtype([(c, "<i8") for c in ("doc_id", "known", "n", "s1", "s2", "group", *SKETCH)])
DOCUMENTS, LISTED = 1 << 60, 1 << 40    # bucket numbers of document rows, and of listed shingles, start here


def meetings(docs: DataFrame, frequent, total: int) -> DataFrame:
    """One pass over the texts that gives two kinds of rows.

    With ``shingle``: (``shingle``, ``group``, ``at``) for prefix shingles that more than one group has (or that are listed).
    Without: a document's ``doc_id``, ``n`` (set size), ``s1``, ``s2`` (128-bit key of its set), its sketch and ``group``
    (key of its prefix and size). Both are packed into one binary value per bucket and batch, which keeps the shuffle small.
    """
    # A quarter of all shingles is in prefixes.
    buckets = max(32, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 4 * _PAIR.itemsize // BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            hashes, ends = shingle_sets(batch.column("text"))
            n, starts = np.diff(ends), ends[:-1]
            s1, s2 = (mix64(_sums(mix64(hashes ^ np.uint64(salt)), starts, ends[1:]) + n.astype(np.uint64)) for salt in (1, 2))
            sketches = list(_sketches(hashes, starts, n))
            hashes, hit = _rare_first(hashes, ends, frequent)
            p = np.where(n > 0, prefix_length(n), 0)
            group = mix64(_sums(mix64(hashes ^ np.uint64(3)), starts, starts + p) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
            ids = batch.column("doc_id")
            keys = np.empty(len(n), _KEYS)
            keys["doc_id"], keys["known"] = ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid())
            keys["n"], keys["s1"], keys["s2"], keys["group"] = n, s1.view(np.int64), s2.view(np.int64), group.view(np.int64)
            for c, x in zip(SKETCH, sketches):
                keys[c] = x
            # Documents of one group deal their prefix once.
            one = np.zeros(len(n), bool)
            one[np.unique(group, return_index=True)[1]] = True
            q = np.where(one, p, 0)
            place = np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q)
            inside = place + np.repeat(starts, q)
            shingle, own = hashes[inside] >> np.uint64(16), np.repeat(group, q)
            pairs = np.empty(len(inside), _PAIR)
            pairs["shingle"], pairs["shingle_low"] = shingle >> np.uint64(16), shingle & np.uint64(0xFFFF)
            pairs["group"], pairs["group_low"] = own >> np.uint64(16), own & np.uint64(0xFFFF)
            pairs["at"] = place * 65536 // np.repeat(n, q)
            where = (mix64(shingle) % np.uint64(buckets)).astype(np.int64)
            hot = hit[inside]
            where[hot] = LISTED + (mix64(own[hot]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            pairs, where = pairs[order], where[order]
            cuts = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)) if len(where) else np.zeros(1, int)
            names = where[cuts[:-1]]
            parts = [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            spread = int(mix64(np.array([len(n) + int(keys["s1"].sum())], np.int64).view(np.uint64))[0] % np.uint64(buckets))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(names, DOCUMENTS + spread)),
                                              pa.array([*parts, keys.tobytes()], pa.binary())], names=["bucket", "pairs"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, data = key[0].as_py(), b"".join(rows.column("pairs").to_pylist())
        if bucket >= DOCUMENTS:
            keys = np.frombuffer(data, _KEYS)
            ids = pa.array(keys["doc_id"], mask=keys["known"] == 0)
            none = pa.nulls(len(keys), pa.int64())
            return pa.table([none, pa.array(keys["group"]), none, ids, *[pa.array(keys[c]) for c in ("n", "s1", "s2", *SKETCH)]], names=names)
        pairs = np.frombuffer(data, _PAIR)
        shingle, group = ((pairs[c].astype(np.uint64) << np.uint64(16)) | pairs[f"{c}_low"] for c in ("shingle", "group"))
        at = pairs["at"]
        if bucket < LISTED:
            order = np.argsort(shingle)
            shingle, group, at = shingle[order], group[order], at[order]
            same = shingle[1:] == shingle[:-1]
            several = np.append(same, False) | np.append(False, same) if len(shingle) else np.zeros(0, bool)
            shingle, group, at = shingle[several], group[several], at[several]
        none = pa.nulls(len(shingle), pa.int64())
        return pa.table([_signed(shingle), _signed(group), pa.array(at.astype(np.int64)), *[none] * (4 + len(SKETCH))], names=names)

    names = ["shingle", "group", "at", "doc_id", "n", "s1", "s2", *SKETCH]
    return docs.mapInArrow(deal, "bucket long, pairs binary").groupBy("bucket").applyInArrow(
        meet, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``node``, ``hashes``) of the documents in ``wanted`` (one column ``node``, distinct).

    A Bloom filter keeps other texts from travelling to the exact join.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            hashes, ends = shingle_sets(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["node", "hashes"])

    near = bloom.probe(docs, "doc_id", bloom.build(wanted, "node"), "_maybe").where("_maybe").drop("_maybe")
    exact = near.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text")
    return exact.mapInArrow(emit, "node long, hashes array<long>")


def _linked(pairs: DataFrame, lists: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``, distinct) whose whole sets link, as a written table.

    First the sketches, the size filter and the prefix filter: what two linked sets share beyond the shingles that both prefixes hold
    lies behind the prefix of one of them. Sets of one group share the whole prefix. An id with several sets (null ``n``) passes.
    Only documents of the pairs left are read again.
    """
    side = [lists.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("entries.shingle").alias(f"t{x}"), F.col("group").alias(f"g{x}"),
                          *[F.col(c).alias(x + c) for c in SKETCH]) for x in "ab"]
    sizes = F.coalesce((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")), F.lit(True))
    counted = pairs.join(side[0], "a").join(side[1], "b").where(_sketch_allows("a", "b", "na", "nb") & sizes)
    beyond = F.ceil(F.greatest("na", "nb") * 0.75) - 1
    shared = F.when(F.col("ga") == F.col("gb"), F.col("na") - F.ceil(F.col("na") * 0.75) + 1).otherwise(F.size(F.array_intersect("ta", "tb")))
    could = write_table(counted.where(F.coalesce(7 * (shared + beyond) >= 3 * (F.col("na") + F.col("nb")), F.lit(True))).select("a", "b"))
    wanted = write_table(could.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = write_table(_sets(docs, wanted))
    one = could.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return write_table(two.select("a", "b", both.alias("k"), (F.size("ha") + F.size("hb")).alias("sum")).where(
        100 * F.col("k") >= 75 * (F.col("sum") - F.col("k"))).select("a", "b").distinct())


def _block_pairs(_: tuple, rows: pa.Table) -> pa.Table:
    """Pairs (``a`` < ``b``) of different components that may link, of the blocks in ``rows``; each pair once."""
    block, node, n, at, component, stray = (rows.column(c).to_numpy() for c in ("block", "node", "n", "at", "component", "stray"))
    order = np.argsort(block, kind="stable")
    block, node, n, at, component, stray = (x[order] for x in (block, node, n, at, component, stray.astype(bool)))
    fresh = np.append(True, block[1:] != block[:-1])
    end = np.append(np.flatnonzero(fresh)[1:], len(block))[np.cumsum(fresh) - 1]
    found, held, left, step = [], 0, np.arange(len(block)), 1
    rest = n - at * n // 65536
    while len(left := left[left + step < end[left]]):
        other = left + step
        need = 3 * (n[left] + n[other])
        ok = ((component[left] != component[other]) & (stray[left] | stray[other]) & (4 * n[left] >= 3 * n[other]) & (4 * n[other] >= 3 * n[left])
              & (7 * rest[left] >= need) & (7 * rest[other] >= need))
        a, b = node[left[ok]], node[other[ok]]
        found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        held += len(a)
        if held > BLOCK_ROWS * 8:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]), pa.int64()), "b": pa.array(np.ascontiguousarray(pairs[:, 1]), pa.int64())})


def _rest_pairs(left: DataFrame) -> DataFrame:
    """Pairs of ``left`` (``shingle``, ``node``, ``n``, ``at``, ``component``) that share a shingle, lie in different components and may link.

    Members outside a shingle's largest component (strays) meet all others. Both kinds are cut into parts of a bounded size
    by hash; each part of strays meets each part of the others in one block, and each other part of strays in another.
    Shingles with the same largest component go to one task as far as its size allows: they hold much the same members, so
    a pair that shares many shingles leaves few tasks.
    """
    by_home = write_table(left.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")))
    homes_of = write_table(by_home.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all")).select(
        "shingle", F.col("m.component").alias("main"), F.ceil(F.col("m.k") / BLOCK_MEMBERS).alias("mains"),
        F.ceil(2 * (F.col("all") - F.col("m.k")) / BLOCK_MEMBERS).alias("strays"), "all"))
    tasks = homes_of.groupBy("main").agg(F.ceil(F.sum("all") / BLOCK_ROWS).alias("salts"))
    homes = homes_of.join(tasks, "main").withColumn("place", F.xxhash64("main", F.pmod(F.xxhash64("shingle"), F.col("salts")))).drop("all", "salts")
    here = left.join(homes, "shingle").withColumn("stray", F.col("component") != F.col("main"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains")))
    def blocks(kind: int, i, j) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    def each(n: str, body) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), body)

    own = F.col("part")
    keys = F.when(F.col("stray"), F.concat(each("mains", lambda i: blocks(0, own, i)), each("strays", lambda i: blocks(1, F.least(own, i), F.greatest(own, i))))).otherwise(
        each("strays", lambda i: blocks(0, i, own)))
    dealt = here.withColumn("part", part).select("shingle", "node", "n", "at", "component", "stray", "place", F.explode(keys).alias("key")).select(
        F.xxhash64("shingle", "key.kind", "key.i", "key.j").alias("block"), "node", "n", "at", "component", "stray", "place")
    groups = max(1, left.count() // BLOCK_ROWS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.groupBy(F.pmod("place", F.lit(groups)).alias("task")).applyInArrow(_block_pairs, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``: smallest node it reaches) for the nodes of undirected ``edges`` (``a``, ``b``).

    Large-star and small-star steps in turn: every round hooks neighbours to the smallest node around, until all edges
    point at the smallest node of their component. Sums by node are combined in map tasks, so hubs are fine.
    """
    def star(rows: DataFrame, large: bool) -> DataFrame:
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else rows
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        out = both.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    now = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).head()
        if seen == state:
            break
        state = seen
        if not seen[0]:
            break
        now = write_table(star(star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _can_link(n: str, at: str, m: str, place: str) -> Column:
    """May two sets of these sizes link if this is the first shingle, in the order of both, that they share?

    Linked sets share 3/7 of their added sizes at least, and what they share cannot lie before the first shared one. So
    every link passes at one shingle, its first.
    """
    n, m = F.col(n), F.col(m)
    need = 3 * (n + m)
    return ((4 * n >= 3 * m) & (4 * m >= 3 * n) & (7 * (n - F.floor(F.col(at) * n / 65536)) >= need)
            & (7 * (m - F.floor(F.col(place) * m / 65536)) >= need))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links lead to)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = write_table(meetings(docs, *frequent_shingles(docs)))
    rows = met.where("shingle IS NULL").select("doc_id", "n", "s1", "s2", "group", *SKETCH)
    nodes = write_table(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n", "group").agg(
        F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in SKETCH]))
    # An id with several texts has several sets, hence neither a sketch nor a size of its own.
    once = F.count(F.lit(1)) == 1
    sketches = nodes.groupBy("node").agg(F.when(once, F.min("n")).alias("n"), F.when(once, F.min("group")).alias("group"), *[
        F.when(once, F.min(c)).alias(c) for c in SKETCH])
    # Groups are expanded to their members; a group of several different sets is a bucket of its own besides.
    members = met.where("shingle IS NOT NULL").groupBy("shingle", "group").agg(F.min("at").alias("at")).join(nodes, "group").select(
        "shingle", "node", "n", "at")
    wide = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("group")
    members = members.unionByName(nodes.join(wide, "group").select(F.col("group").alias("shingle"), "node", "n", F.lit(0).cast("long").alias("at")))
    buckets = write_table(members)
    sizes = buckets.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    lists = write_table(buckets.join(sizes, "shingle").groupBy("node").agg(
        F.collect_list(F.struct("shingle", "at", F.col("n").alias("m"))).alias("entries"), (F.sum("k") / F.max("n")).alias("score")).join(sketches, "node"))
    # Round 1: the centre is the member whose shingles are the most common, which the base of a family of copies is.
    spread = lists.select("node", "score", F.explode("entries").alias("e")).select("node", "score", "e.shingle", "e.at", F.col("e.m").alias("n"))
    best = spread.groupBy("shingle").agg(F.max(F.struct("score", (-F.col("node")).alias("c"), F.col("n").alias("n"), F.col("at").alias("at"))).alias("m"))
    pairs = spread.join(best, "shingle").where(_can_link("n", "at", "m.n", "m.at")).select(
        F.col("node").alias("a"), (-F.col("m.c")).alias("b")).where("a <> b").distinct()
    found = components(_linked(pairs, lists, docs))

    def open_buckets(known: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        home = lists.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.explode("entries").alias("e"))
        here = write_table(home.select("node", "component", "e.shingle", "e.at", F.col("e.m").alias("n")))
        several = here.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return write_table(here.join(several.select("shingle"), "shingle"))

    # Round 2: a random centre for what is apart yet.
    left = open_buckets(found)
    best = left.groupBy("shingle").agg(F.max(F.struct(F.xxhash64("node", F.lit(2)).alias("h"), F.col("node").alias("c"), F.col("component").alias("cc"),
                                                      F.col("n").alias("n"), F.col("at").alias("at"))).alias("m"))
    pairs = left.join(best, "shingle").where((F.col("component") != F.col("m.cc")) & _can_link("n", "at", "m.n", "m.at")).select(
        F.col("node").alias("a"), F.col("m.c").alias("b")).distinct()
    found = components(_edges(found).unionByName(_linked(pairs, lists, docs)))
    # The rest: whoever is outside the largest component of a bucket meets the other components there.
    found = components(_edges(found).unionByName(_linked(_rest_pairs(open_buckets(found)), lists, docs)))
    homes = nodes.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("home"))
    full = rows.where("n > 0 AND doc_id IS NOT NULL").join(homes, ["s1", "s2", "n"]).select("doc_id", "n", "home")
    rest = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("home"))
    return full.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("home").alias("component_id"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; rows without id stay."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct().alias("gone")
    rows = docs.alias("docs")
    return rows.join(gone, F.col("docs.doc_id") == F.col("gone.id"), "left_anti").select("docs.*")


def op6(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
