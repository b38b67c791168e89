"""Exact quantiles of wide tables without moving their rows.

A mergeable sketch gives a bracket around every wanted position. A second pass counts what lies below, on and inside the
brackets and gathers the values strictly inside, a bounded number. Where more than that is left inside, a sketch of the
inside alone narrows the bracket, and it is counted again. Only partial aggregates are exchanged, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import q

ACCURACY = 10_000      # the sketch is off by at most 1/ACCURACY of the values
GATHERED = 20_000      # values that are gathered inside one bracket at most
COLUMNS = 32           # columns of one pass


@dataclass
class _Bracket:
    """The values at the adjacent positions ``first`` and ``last`` (from 0) of a column are in [low, high]."""

    column: str
    name: str
    part: float                # how far the quantile is on the way from the first to the last
    first: int
    last: int
    low: float
    high: float
    inside: float              # values strictly inside at most
    below: int = 0             # values up to ``low``, once counted
    slack: float = 2.0 / ACCURACY
    answer: float | None = None


def _around(x: Column, share: float, slack: float = 2.0 / ACCURACY) -> Column:
    """The two ends of a bracket around ``share`` of the values of ``x``."""
    return F.percentile_approx(x, [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)


def _left(n: float, slack: float = 2.0 / ACCURACY) -> float:
    """Values strictly inside a bracket of the sketch over ``n`` values: slack and error on both sides."""
    return (2 * slack + 2.0 / ACCURACY) * n + 2


def _row(wide: DataFrame, aggs: list[Column]):
    return wide.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()


def _start(wide: DataFrame, probs: dict[str, float]) -> tuple[list[_Bracket], dict[str, tuple]]:
    """Brackets of all columns and probabilities, and (smallest, largest) of every column."""
    row = iter(_row(wide, [a for c in wide.columns for a in (F.count(q(c)), F.min(q(c)), F.max(q(c)), *[_around(q(c), p) for p in probs.values()])]))
    out, ends = [], {}
    for c in wide.columns:
        n, ends[c] = next(row), (next(row), next(row))
        for name, p in probs.items():
            low, high = next(row) or (None, None)
            if not n:
                continue
            at = p * (n - 1)
            first = math.floor(at)
            # Few values are gathered whole.
            out.append(_Bracket(c, name, at - first, first, math.ceil(at), *(ends[c] if n <= GATHERED else (low, high)), n if n <= GATHERED else _left(n)))
    return out, ends


def _inside(b: _Bracket) -> Column:
    x = q(b.column)
    return F.when((x > b.low) & (x < b.high), x)


def _count(wide: DataFrame, brackets: list[_Bracket], ends: dict[str, tuple]) -> None:
    """Answer what the brackets hold, and learn how much is inside the others."""
    row = iter(_row(wide, [a for b in brackets for x, inside in [(q(b.column), _inside(b))] for a in (
        F.count_if(x < b.low), F.count_if(x == b.low), F.count(inside), F.count_if((x == b.high) & (b.low < b.high)),
        F.array_sort(F.collect_list(inside)) if b.inside <= GATHERED else F.lit(None))]))
    for b in brackets:
        below, on_low, inside, on_high, values = (next(row) for _ in range(5))
        if b.first < below or b.last >= below + on_low + inside + on_high:
            # Outside: the sketch was further off than it says. Again from all values, with more slack.
            (b.low, b.high), b.inside, b.slack = ends[b.column], math.inf, 8 * b.slack
            continue
        found = []
        for at in (b.first - below, b.last - below):
            if at < on_low:
                found.append(b.low)
            elif at >= on_low + inside:
                found.append(b.high)
            elif values is not None:
                found.append(values[at - on_low])
        if len(found) == 2:
            b.answer = found[0] + (found[1] - found[0]) * b.part
        b.inside, b.below = inside, below + on_low


def _narrow(wide: DataFrame, brackets: list[_Bracket]) -> None:
    """Sketch the inside of the brackets that hold too much."""
    row = _row(wide, [_around(_inside(b), min(1.0, max(0.0, (b.first - b.below + 0.5) / b.inside)), b.slack) for b in brackets])
    for b, (low, high) in zip(brackets, row):
        # A position on an end keeps that end.
        b.low = low if b.first >= b.below else b.low
        b.high = high if b.last < b.below + b.inside else b.high
        b.inside = _left(b.inside, b.slack)


def wide_quantiles(wide: DataFrame, probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """column -> name -> exact, linearly interpolated quantile of the non-null values; columns without values are left out.

    ``wide`` has columns of doubles only. It is read twice, and twice more for every factor of some thousand above about
    thirty million rows.
    """
    out: dict[str, dict[str, float]] = {}
    for lo in range(0, len(wide.columns), COLUMNS):
        part = wide.select(*[q(c) for c in wide.columns[lo:lo + COLUMNS]])
        brackets, ends = _start(part, probs)
        while left := [b for b in brackets if b.answer is None]:
            _count(part, left, ends)
            large = [b for b in left if b.answer is None and GATHERED < b.inside < math.inf]
            if large:
                _narrow(part, large)
        for b in brackets:
            out.setdefault(b.column, {})[b.name] = b.answer
    return out
