"""Language identification: words first, then shorter and shorter character n-grams for words never seen.

Rules for edge cases: a null text, or one without a letter, is ``und`` with score 0; a text of any length is read whole;
a text none of whose parts was ever seen gets the most frequent language; equal scores go to the first language by name;
repeated rows are judged alike; null languages are not learned from; without any training rows all is ``und``; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm.common import SPACE_RUN, Words, crc_mod, slices, table

FIT_ROWS = 40_000                     # labelled documents to learn from (a share of that size, by hash of the id)
WORD_TABLE, GRAM_TABLE = 200_000, 50_000   # most frequent words, and n-grams of each length, that are kept
LONGEST = 5
LEAST_SEEN = 2                        # a word seen less often is left to its n-grams
EVIDENCE = 12.0                       # words after which the posterior no longer sharpens
NO_LANGUAGE = "und"


class Model:
    """Log frequencies per language of known words and of n-grams: a row of ``logs`` for each entry."""

    def __init__(self, languages: list[str], priors: np.ndarray, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        self.languages, self.priors = languages, priors
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: len(words) + i for i, g in enumerate(grams)}
        self.logs = np.vstack([np.empty((0, len(languages))), *[self._logs(c) for c in (words, grams) if c]])

    @staticmethod
    def _logs(counts: dict[str, np.ndarray]) -> np.ndarray:
        rows = np.stack(list(counts.values())).astype(np.float64)
        logs = np.log((rows + 0.5) / (rows.sum(0) + 0.5 * len(rows)))
        # Only what tells languages apart counts, so every entry is centred.
        return logs - logs.max(axis=1, keepdims=True)

    def entries(self, w: str) -> list[int]:
        """Rows that speak for a word: its own, else those of the longest n-grams that are known."""
        own = self.words.get(w)
        if own is not None:
            return [own]
        padded, grams = f" {w} ", self.grams
        for n in range(LONGEST, 0, -1):
            known = [g for i in range(len(padded) - n + 1) if (g := grams.get(padded[i:i + n])) is not None]
            if known:
                return known
        return []

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = Words(texts)
        score, k = np.zeros(len(words.count)), len(self.languages)
        if not k:
            return [NO_LANGUAGE] * len(score), score
        coded = _letters(words.names).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)[words.code] if len(words.code) else words.code
        cleaned = coded.dictionary.to_pylist()
        found = [self.entries(w) if w else [] for w in cleaned]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        of_word = np.repeat(np.arange(len(found)), sizes)
        flat = np.fromiter((e for row in found for e in row), np.int64, int(sizes.sum()))
        rows = np.stack([np.bincount(of_word, self.logs[flat, j], len(found)) for j in range(k)], 1) / np.maximum(sizes, 1)[:, None]
        letters = np.fromiter(map(bool, cleaned), bool, len(cleaned))
        doc = np.repeat(np.arange(len(score)), words.count)
        pairs, times = np.unique(doc * max(1, len(cleaned)) + code, return_counts=True)
        at, of = pairs % max(1, len(cleaned)), pairs // max(1, len(cleaned))
        total = np.stack([np.bincount(of, rows[at, j] * times, len(score)) for j in range(k)], 1)
        used = np.bincount(of, (sizes[at] > 0) * times, len(score))
        some = np.bincount(of, letters[at], len(score)) > 0
        z = total / np.maximum(used, 1)[:, None] * np.minimum(used, EVIDENCE)[:, None] + np.log(self.priors) * (used == 0)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return ([self.languages[b] if ok else NO_LANGUAGE for b, ok in zip(best, some)],
                np.where(some, p[np.arange(len(p)), best], 0.0))


def _letters(names: pa.Array) -> pa.Array:
    """Words as they are looked up: letters only, in lower case."""
    return pc.utf8_lower(pc.replace_substring_regex(names.cast(pa.large_string()), r"[^\p{L}]+", ""))


def train(docs: DataFrame, learn_from: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Counts over at most ``fit_rows`` labelled documents, by Spark; the driver gets the frequent entries only."""
    known = docs.where("lang IS NOT NULL")
    if learn_from is not None:
        known = known.where(learn_from)
    # A hash picks the sample in the scan; a LIMIT would gather it in one task.
    share = fit_rows / max(1, known.count())
    near = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20))
    picked = (known.where(near) if share < 1 else known).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    word = F.lower(F.regexp_replace("w", r"[^\p{L}]+", ""))
    words = write_table(picked.select("lang", F.explode(F.split("text", SPACE_RUN)).alias("w")).groupBy("lang", "w").agg(
        F.count(F.lit(1)).alias("n")).select("lang", word.alias("w"), "n").where("w <> ''").groupBy("lang", "w").agg(F.sum("n").alias("n")))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty(0), {}, {})

    def counts(long: DataFrame, key: str, most: int) -> dict[str, np.ndarray]:
        by = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
        top = long.groupBy(key).agg(F.sum("n").alias("total"), *by).where(F.col("total") >= LEAST_SEEN).orderBy(
            F.desc("total"), key).limit(most).toArrow()
        rows = np.stack([top.column(f"n{i}").to_numpy() for i in range(len(languages))], 1)
        return dict(zip(top.column(key).to_pylist(), rows))

    grams: dict[str, np.ndarray] = {}
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    for n in range(1, LONGEST + 1):
        grams |= counts(words.select("lang", "n", F.explode(_grams(padded, n)).alias("g")), "g", GRAM_TABLE)
    return Model(languages, np.array([sizes[x] for x in languages]) / sum(sizes.values()), counts(words, "w", WORD_TABLE), grams)


def _grams(padded: Column, n: int) -> Column:
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))),
                        lambda i: F.substring(padded, i, F.lit(n)))
    return F.filter(whole, lambda g: (F.length(g) == n) & (F.trim(g) != ""))


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``; a quarter of the ids (by CRC) is never learned from."""
    model = train(docs, crc_mod(F.col("doc_id"), 4) != 2, fit_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10(spark, folder):
    return identify(table(spark, folder, "documents"))
