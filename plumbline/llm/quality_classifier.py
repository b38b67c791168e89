"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Rules for edge cases: a null, empty or blank text pools to zeros and is scored like any other; a text of any length is
pooled whole; repeated rows get equal scores; labels that are null or name no document are not learned from; with labels
of fewer than two kinds every score is the share of good labels (1 without labels); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Words, crc_mod, mix64, slices, table

BUCKETS, DIM = 1 << 14, 32    # hashed words and their vectors: 2 MB, sent to every task
REACH = 2                     # neighbours on either side that a word's vector collects
FIT_ROWS = 20_000             # bound on the labelled documents the network is trained on
HIDDEN, EPOCHS, SEED = 32, 60, 17
LEAST_SCORE = 0.3


def _streams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket per word, once by its letters in lower case and once by its shape (``Ab,`` and ``xy##`` differ)."""
    names = words.names.cast(pa.large_string())
    plain = pc.replace_substring_regex(pc.utf8_lower(names), r"[^\p{L}\p{N}]+", "")
    shape = pc.replace_substring_regex(names, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"[\p{Ll}\p{Lo}]+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{N}+", "0")

    def bucket(texts: pa.Array, salt: int) -> np.ndarray:
        coded = texts.dictionary_encode()
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(coded.dictionary))
        return (h % np.uint64(BUCKETS)).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    if not len(names):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return bucket(plain, 1)[words.code], bucket(shape, 2)[words.code]


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket: two places, and the sign at each."""
    h = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    place = np.stack([h % np.uint64(DIM), (h >> np.uint64(20)) % np.uint64(DIM)], 1).astype(np.int64)
    sign = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)], 1).astype(np.int64) * 2 - 1
    return place, sign


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of the hashed words: sums of the index vectors of their neighbours over the whole corpus.

    A task adds up its documents; sums per bucket go through one shuffle of at most ``BUCKETS`` rows a task. They are
    whole numbers, so any order of adding gives the same vectors.
    """
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors()
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            doc = np.repeat(np.arange(len(words.count)), words.count)
            for stream in _streams(words):
                for step in range(1, REACH + 1):
                    if len(stream) <= step:
                        continue
                    same = doc[step:] == doc[:-step]
                    a, b = stream[:-step][same], stream[step:][same]
                    for to, at in ((a, b), (b, a)):
                        for k in (0, 1):
                            total += np.bincount(to * DIM + place[at, k], sign[at, k], BUCKETS * DIM).astype(np.int64)
        total = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, d]) for d in range(DIM)]],
                                         names=["bucket", *[f"d{d}" for d in range(DIM)]])

    schema = "bucket long, " + ", ".join(f"d{d} long" for d in range(DIM))
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(collect, schema).groupBy("bucket").agg(
        *[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).toArrow()
    out = np.zeros((BUCKETS, DIM))
    out[sums.column("bucket").to_numpy()] = np.stack([sums.column(f"d{d}").to_numpy() for d in range(DIM)], 1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, mean shape vector, their lengths, and four ratios."""
    words = Words(texts)
    n = words.count
    doc = np.repeat(np.arange(len(n)), n)
    safe = np.maximum(n, 1)[:, None]
    parts = []
    for stream in _streams(words):
        # Per text and bucket one term, so that the sum is over distinct words.
        pairs, times = np.unique(doc * BUCKETS + stream, return_counts=True)
        rows, at = pairs // BUCKETS, pairs % BUCKETS
        mean = np.zeros((len(n), DIM))
        starts = np.searchsorted(rows, np.arange(len(n)))
        if len(pairs):
            sums = np.add.reduceat(vectors[at].astype(np.float64) * times[:, None], np.minimum(starts, len(pairs) - 1), axis=0)
            mean = np.where(n[:, None] > 0, sums, 0.0) / safe
        different = np.diff(np.r_[starts, len(pairs)])
        parts += [mean, np.linalg.norm(mean, axis=1, keepdims=True), different[:, None] / safe]
    again = np.bincount(doc[1:], (words.code[1:] == words.code[:-1]) & (doc[1:] == doc[:-1]), len(n)) if len(doc) > 1 else np.zeros(len(n))
    return np.concatenate([*parts, again[:, None] / safe, np.log1p(n)[:, None]], axis=1).astype(np.float32)


class Network:
    """Two layers of numpy; a temperature fitted on a held-back fifth turns its logit into a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.constant = None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5:]
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.maximum(x[at] @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[at]) / len(at)
                dh = np.outer(d, w[2]) * (h > 0)
                grads = [x[at].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            z = self._logit(x[held])
            ladder = np.geomspace(0.5, 10, 60)
            loss = [np.mean(np.logaddexp(0, -np.where(y[held] > 0, z, -z) / t)) for t in ladder]
            self.temperature = float(ladder[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, fit_rows: int = FIT_ROWS):
    """(vectors, network): vectors from all ``docs``, the network from ``fit_rows`` labelled ones at most (by hash of id)."""
    vectors = word_vectors(docs)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.orderBy(F.xxhash64("_id", F.lit(8)), "_id", "_y").limit(fit_rows)
    # At most fit_rows rows of two numbers, so a broadcast is bounded.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select(
        "_id", "text", "_y")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = pooled(batch.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y").cast(pa.int32()),
                                              pa.array(list(rows), pa.list_(pa.float32()))], names=["_id", "_y", "x"])

    # Documents that repeat an id could exceed the bound, hence the second limit.
    got = texts.mapInArrow(pool, "_id long, _y int, x array<float>").orderBy(F.xxhash64("_id", F.lit(8)), "_id", "_y").limit(fit_rows).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(got), -1) if len(got) else np.empty((0, 1))
    return vectors, Network(x.astype(np.float64), (got.column("_y").to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``."""
    vectors, network = model
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_pool"):
            got = network.score(pooled(batch.column("_pool"), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(got)], names=[*keep, "_score"])

    return inner.mapInArrow(run, f"{kinds}, _score double")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``; a fifth of the ids (by CRC) is never learned from."""
    model = train(docs, labels, crc_mod(F.col("_id"), 5) != 0, fit_rows)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= LEAST_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, as they are, that score ``LEAST_SCORE`` or more under a network trained on all labels."""
    model = train(docs, labels, None, fit_rows)
    return score(docs, model, docs.columns).where(F.col("_score") >= LEAST_SCORE).drop("_score")


def op8(spark, folder):
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
