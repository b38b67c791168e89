"""Product codes and exact search against full searches in numpy; the audit against sums over all terms."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, exact_topk, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, code string, v string, n string, rank string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(parts)


def nearest(parts, entries):
    apart = ((parts[:, None] - entries[None]) ** 2).sum(2)
    return apart.argmin(1), apart.min(1)


@pytest.mark.parametrize("scale, entries", [(1, 2), (40, 16), (4096, 7)])
def test_cells_equal_a_full_search(scale, entries):
    rng = np.random.default_rng(scale)
    parts = np.floor(rng.normal(size=(4000, 5)) * scale).astype(np.int64)
    cells = vector_codes.Cells(parts[rng.permutation(len(parts))[:entries]])
    for batch in np.array_split(parts, 7):
        code, apart = cells.nearest(batch)
        want = nearest(batch, cells.entries)
        assert (code == want[0]).all() and (apart == want[1]).all()


def test_cells_remember_and_rule_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 5000)] + rng.integers(-3, 4, (5000, 8))
    cells = vector_codes.Cells(centres)
    allowed = cells.of(parts)
    assert allowed.sum(1).mean() < 4 and cells.worked_out < 2500
    before = cells.worked_out
    cells.of(parts)
    assert cells.worked_out == before


def full_codes(rows, parts, entries, rounds, scale):
    """Codes and codebooks by full search; vectors padded with zeros."""
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    x = np.zeros((len(rows), width * parts), np.int64)
    for i, (_, v, _) in enumerate(rows):
        x[i, :len(v)] = [min(max(math.floor(c * scale), -(1 << 27)), 1 << 27) for c in v]
    first = sorted((r[0], x[i, :len(r[1])].tolist(), i) for i, r in enumerate(rows) if r[0] is not None)[:entries]
    books = [np.array([x[i, p * width:(p + 1) * width] for *_, i in first]) for p in range(parts)]
    pieces = [x[:, p * width:(p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            code, _ = nearest(pieces[p], books[p])
            for e in set(code.tolist()):
                books[p][e] = pieces[p][code == e].sum(0) // (code == e).sum()
    found = [nearest(pieces[p], books[p]) for p in range(parts)]
    return [("".join(f"{c[i]:02x}" for c, _ in found), int(sum(e[i] for _, e in found))) for i in range(len(rows))], np.array(books)


def test_codes_with_repeated_ids_and_odd_lengths(spark):
    rng = random.Random(3)
    rows = [(i % 40 if i % 11 else None, [rng.gauss(0, 1) for _ in range(rng.choice([0, 3, 10, 12]))], "x" if i % 3 else None) for i in range(150)]
    rows += rows[:9] + [(1000, [1e30, -1e30] * 6, "x")]
    bad = [(5, None, "x"), (6, [1.0, None], "x"), (7, [float("nan")], "x"), (8, [float("-inf"), 1.0], None)]
    coded, books = vector_codes.compress(frame(spark, rows + bad), 4, 9, 3, 50)
    want, want_books = full_codes(rows, 4, 9, 3, 50)
    assert (books == want_books).all()
    got = Counter((r.vec_id, r.label, r.code, r.error) for r in coded.collect())
    assert got == Counter((i, label, *w) for (i, _, label), w in zip(rows, want))


def test_codes_without_ids_or_components(spark):
    rows = [(None, [1.0, 2.0], "x"), (None, [0.0], None)]
    coded, books = vector_codes.compress(frame(spark, rows), 2, 4, 2, 1)
    assert sorted((r.code, r.error) for r in coded.collect()) == [("0000", 0), ("0000", 5)] and books.size == 0
    coded, _ = vector_codes.compress(frame(spark, [(1, [], "x")]), 2, 4, 2, 1)
    assert [tuple(r) for r in coded.collect()] == [(1, "x", "0000", 0)]


def full_search(rows, every, k, scale):
    width = max(len(v) for _, v in rows)
    short = [(i, [math.floor(c * scale) for c in v]) for i, v in rows]
    whole = [(i, v + [0] * (width - len(v))) for i, v in short]
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        mine = min(v for i, v in short if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in whole if i != q)
        out += [(q, r + 1, i, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("kind", ["ties", "clusters", "huge", "few"])
def test_search_equals_a_full_search(spark, monkeypatch, kind):
    rng = random.Random(kind)
    if kind == "ties":
        rows = [(i % 300, [float(rng.randint(-1, 1)) for _ in range(rng.choice([2, 4]))]) for i in range(700)]
    elif kind == "clusters":
        rows = [(i, [rng.gauss(3 * (i // 100), 0.1), rng.gauss(-2, 0.1), rng.random()]) for i in range(1200)]
    elif kind == "huge":
        rows = [(i, [rng.choice([1e9, -1e9, 3.5e17, 1.0]) * rng.random() for _ in range(3)]) for i in range(90)]
    else:
        rows = [(0, [1.0, 2.0]), (20, []), (3, [0.5])]
    monkeypatch.setattr(exact_topk, "SLAB_VALUES", 40)     # several slabs
    df = frame(spark, [(*r, None) for r in rows] + [(40, None, None), (60, [float("nan")], None), (None, [9.0, 9.0], None)])
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 7, 64).collect()
    want = full_search(rows, 20, 7, 64)
    assert sorted((r.query_id, r["rank"], r.score) for r in got) == sorted((q, k, s) for q, k, _, s in want)
    if kind != "huge":      # scores beyond a long tie
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_search_skips_blocks():
    rng = np.random.default_rng(2)
    centre = np.repeat(np.arange(40), exact_topk.BLOCK_ROWS) * 10.0
    rows = np.floor(np.column_stack([centre, rng.normal(0, 1, (len(centre), 3))]))
    asking = np.array([[1.0, 0, 0, 0], [-1.0, 0, 0, 1.0]])
    best = exact_topk.Best(np.array([-2, -1]), asking, 5)
    best.meet(np.arange(len(rows)), rows)
    assert best.scored_blocks < best.seen_blocks / 4
    for q in range(2):
        score = rows @ asking[q]
        assert best.found[q].tolist() == np.lexsort((np.arange(len(rows)), -score))[:5].tolist()


def full_audit(rows, least, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t, _, _ in rows]
    groups, df, out = {}, Counter(), []
    for found, (_, lang, source) in zip(terms, rows):
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        df.update({(lang or "", t) for t in set(found)})
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in df.items() if g == lang and n >= least)
        own = {s: c for (g, s), c in groups.items() if g == lang}

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        weights, whole = {s: p(c) for s, c in own.items()}, p(sum(own.values(), Counter()))
        for s in own:
            def f(q, t):
                return (weights[s][t] - q[t]) ** 2 // (weights[s][t] + q[t])
            pairs = [(sum(f(weights[o], t) for t in kept), o) for o in own if o != s]
            best = [(f(whole, t), t) for t in kept if own[s][t] and weights[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("cells", [10, 4096])
def test_audit_equals_sums_over_terms(spark, monkeypatch, cells):
    rng = random.Random(8)
    words = ["été", "\U0001f600b", "Abc", "ABC", " x"] + ["".join(rng.choice("abcdeF") for _ in range(3)) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(" 1-".join(rng.choices(words, weights, k=rng.choice([0, 3, 40, 200]))), rng.choice(["en", "de", None, ""]),
             rng.choice(["web", "web", "é", None, "books"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "en", "blank"), ("unseen words only", "xx", "a"), (None, "xx", "b"), ("0 1 2", "xx", "c"), ("lone", "yy", "a")]
    rows += rows[:20]
    monkeypatch.setattr(divergence, "CHUNK_CELLS", cells)
    df = spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], "text string, lang string, source string, term string, n string, p string, chunk string")
    got = divergence.audit(df.repartition(4), 10, 10).collect()
    assert sorted(tuple(r) for r in got) == full_audit(rows, 10, 10)
