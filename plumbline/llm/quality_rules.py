"""Quality rules: text statistics, and a decision list learned from labelled ones by sequential covering.

Rules for edge cases: a null or empty text has no words and fails the base rules; a text below eight words has no
repeated window; repeated rows are judged alike; labels that are null or name no document are not learned from; without
labels of both kinds the list is empty and keeps all that passes the base rules; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import write_table
from plumbline.llm.common import SPACE_RUN, SPACES, WORD, let, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BINS = 24          # thresholds a feature may be cut at
MAX_RULES, MAX_TERMS = 8, 3
MIN_PRECISION = 0.8   # of a rule on the pruning third, else learning stops
FIT_ROWS = 500_000    # bound on the labelled rows that are learned from (by hash of the id)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words inside a window of eight that occurs twice or more; windows are compared by 64-bit hashes of the text."""
    def join(a: Column, step: int) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), lambda x, y: F.xxhash64(x, y))

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def starts(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(
            (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]),
            F.get(s, k - 1)["h"] == e["h"], F.get(s, k + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"])))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(starts(windows), covered)).otherwise(F.lit(0))

    one = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(let(let(one, lambda a: join(a, 1)), lambda b: join(b, 2)), lambda c: join(c, 4))
    return F.when(F.size(words) >= WINDOW, let(windows, count)).otherwise(F.lit(0))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts per document, in one pass over the text and without a shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    per_line = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    per_word = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"),
                                             _repeated_words(w).alias("repeated")))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return docs.select("doc_id", per_word.alias("w"), F.length(F.translate(text, SPACES, "")).alias("word_chars"),
                       _without(text, SYMBOLS).alias("n_symbols"), per_line.alias("n_dup_lines"), upper.alias("n_upper"),
                       _without(text, "!").alias("n_bangs")).select(
        "doc_id", F.col("w.n").cast("long").alias("n_words"), F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"), F.col("n_dup_lines").cast("long"),
        F.col("w.repeated").cast("long").alias("n_repeat_words"), F.col("w.different").cast("long").alias("n_different"),
        F.col("n_upper").cast("long"), F.col("n_bangs").cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"words": F.col("n_words").cast("double"), "word_length": chars / n, "symbol_share": F.col("n_symbols") / n,
            "dup_lines": F.col("n_dup_lines").cast("double"), "repeat_share": F.col("n_repeat_words") / n,
            "different_share": F.col("n_different") / n, "upper_share": F.col("n_upper") / chars, "bang_share": F.col("n_bangs") / n}


def _term(name: str, side: str, cut: float) -> Column:
    return F.col(name) <= F.lit(cut) if side == "<=" else F.col(name) > F.lit(cut)


def _all(terms) -> Column:
    return reduce(lambda a, t: a & _term(*t), terms, F.lit(True))


def learn_rules(labelled: DataFrame, names: list[str]) -> list[list[tuple[str, str, float]]]:
    """Ordered rules that reject: each a conjunction of (feature, side, threshold).

    ``labelled`` (a written table) has the features, ``bad`` (boolean) and ``prune`` (boolean). Every step is one grouped
    count over (feature, bin): the driver sees a few hundred numbers and picks the term with the best information gain.
    A grown rule is pruned on the third held back, and learning stops at the first rule that is not precise there.
    """
    import math

    ladder = labelled.agg(*[F.percentile_approx(n, [i / BINS for i in range(BINS)], 10_000).alias(n) for n in names]).head()
    cuts = {n: sorted(set(ladder[n] or [])) for n in names}

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[name]]), lambda c: c < F.col(name)))

    binned = F.array(*[F.struct(F.lit(n).alias("f"), bin_of(n).alias("b")) for n in names if cuts[n]])
    rules, left = [], F.lit(True)
    while len(rules) < MAX_RULES and any(cuts.values()):
        terms: list[tuple[str, str, float]] = []
        while len(terms) < MAX_TERMS:
            got = labelled.where(left & _all(terms) & ~F.col("prune")).select("bad", F.explode(binned).alias("x")).groupBy(
                "x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            bins: dict[str, dict[int, tuple[int, int]]] = {}
            for r in got:
                bins.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            some = next(iter(bins.values()), {})
            p0, n0 = sum(v[0] for v in some.values()), sum(v[1] for v in some.values())
            if p0 < 5 or n0 == 0:
                break
            best = (1e-9, None)
            for f in names:
                below_p = below_n = 0
                for i, cut in enumerate(cuts[f]):
                    p, n = bins.get(f, {}).get(i, (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    # Bin i holds the values over i thresholds, so bins up to i are those at or below threshold i.
                    for side, (p, n) in (("<=", (below_p, below_n)), (">", (p0 - below_p, n0 - below_n))):
                        if p >= 5:
                            gain = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1)))
                            if gain > best[0]:
                                best = (gain, (f, side, cut))
            if best[1] is None:
                break
            terms.append(best[1])
        if not terms:
            break
        seen = labelled.where(left & F.col("prune")).agg(*[F.count_if(_all(terms[:k]) & b).alias(f"{w}{k}") for k in range(
            1, len(terms) + 1) for w, b in (("p", F.col("bad")), ("n", ~F.col("bad")))]).head()
        worth = {k: (seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]) for k in range(1, len(terms) + 1)}
        size = max(worth, key=lambda k: (worth[k], -k))
        if seen[f"p{size}"] < 1 or seen[f"p{size}"] < MIN_PRECISION * (seen[f"p{size}"] + seen[f"n{size}"]):
            break
        rules.append(terms[:size])
        left = left & ~_all(terms[:size])
    return rules


def rules_column(rules) -> Column:
    """The list as one ordered conditional expression: number of the first rule that fires, 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics per document with ``base_failed``, ``rule`` (that rejects it; 0: none) and ``kept``."""
    stats = write_table(text_statistics(docs).select("*", *[c.alias(f) for f, c in features().items()]))
    names = list(features())
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Learning looks at what passes the base rules; the rest is out anyway.
    labelled = write_table(stats.where(~base_failed()).join(picked, "doc_id").select(
        *names, "bad", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(3)) == 0).alias("prune")))
    rule = rules_column(learn_rules(labelled, names))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & (rule == 0)).alias("kept"))


def op1(spark, folder):
    return apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
