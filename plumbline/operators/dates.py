"""Date coverage of a table or of every entity: range, frequency, regularity, gaps.

All functions take ``keys`` (entity columns, may be empty) and work on the
distinct dates of each key with their copy counts and their predecessor, which
one range-partitioned pass provides (``date_runs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import calendar as cal
from plumbline.functions.columns import micros, to_moment, to_number
from plumbline.functions.runs import attach_by_chunk, explode_range, ranked_runs
from plumbline.functions.tables import write_table

DAY = cal.DAY


class DateRuns:
    """Distinct dates per key: keys..., chunk, ts, copies, start, total, prev."""

    def __init__(self, rows: DataFrame, keys: list[str], shown: list[str]):
        self.rows, self.keys, self.shown = rows, keys, shown

    def show(self, df: DataFrame, *cols) -> DataFrame:
        return df.select(*self.shown, *cols)


def date_runs(df: DataFrame, date: str, keys: list[str] | None = None) -> DateRuns:
    keys = list(keys or [])
    dates = df.select(*keys, to_moment(df, date).cast("timestamp_ntz").alias("ts"))
    dates = dates.dropna(subset=[*keys, "ts"])
    inner = keys
    if not keys:
        dates, inner = dates.withColumn("_table", F.lit(0)), ["_table"]
    return DateRuns(write_table(ranked_runs(dates, inner, ["ts"])), inner, keys)


def date_range(df: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """keys, start, end, n, error: plain aggregate, no ordering needed."""
    keys = list(keys or [])
    dates = df.select(*keys, to_moment(df, date).alias("ts")).dropna(subset=[*keys, "ts"])
    return dates.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("ts").alias("n")
    ).withColumn("error", F.when(F.col("n") < 2, F.lit("Not enough valid date values")))


def _delta() -> Column:
    return micros(F.col("ts")) - micros(F.col("prev"))


def delta_histogram(runs: DateRuns) -> DataFrame:
    """keys, delta_days (rounded), n: steps between consecutive rows, repeats included."""
    return _delta_counts(runs).groupBy(*runs.keys, "delta_days").agg(F.sum("n").alias("n"))


def delta_counts(runs: DateRuns) -> DataFrame:
    return runs.show(delta_histogram(runs), "delta_days", "n")


def _delta_counts(runs: DateRuns) -> DataFrame:
    """keys, whole_days (cut), delta_days (rounded half to even), n."""
    step = F.struct(F.floor(_delta() / DAY).alias("whole_days"),
                    F.bround(_delta() / F.lit(float(DAY)), 0).cast("bigint").alias("delta_days"),
                    F.when(F.col("prev").isNotNull(), 1).otherwise(0).cast("bigint").alias("n"))
    repeat = F.struct(F.lit(0).cast("bigint").alias("whole_days"), F.lit(0).cast("bigint").alias("delta_days"),
                      (F.col("copies") - 1).alias("n"))
    return runs.rows.select(*runs.keys, F.inline(F.array(step, repeat))).where("n > 0").groupBy(
        *runs.keys, "whole_days", "delta_days").agg(F.sum("n").alias("n"))


def frequency(runs: DateRuns, expected: str | DataFrame | None = None) -> DataFrame:
    """One row per key: most common and median delta, regularity, match with an expected frequency (of every key)."""
    hist = delta_histogram(runs)
    by = W.partitionBy(*runs.keys)
    upto = by.orderBy("delta_days").rowsBetween(W.unboundedPreceding, 0)
    cum, tot = F.col("_cum"), F.col("_tot")
    ranked = hist.withColumn("_cum", F.sum("n").over(upto)).withColumn("_tot", F.sum("n").over(by))
    low, high = F.floor((tot - 1) / 2), F.ceil((tot - 1) / 2)
    holds = lambda pos: (cum > pos) & (cum - F.col("n") <= pos)
    out = ranked.groupBy(*runs.keys).agg(
        F.count(F.lit(1)).alias("n_deltas"),
        F.max_by("delta_days", F.struct("n", -F.col("delta_days"))).alias("most_common"),
        ((F.max(F.when(holds(low), F.col("delta_days")))
          + F.max(F.when(holds(high), F.col("delta_days")))) / 2.0).alias("median_days"),
        F.sum("n").alias("n_steps"))
    out = out.withColumn("is_regular", F.col("n_deltas") == 1)
    match = F.lit(None).cast("boolean")
    if isinstance(expected, DataFrame):
        out = out.join(expected.select(*runs.keys, F.col("freq").alias("_freq")), runs.keys, "left")
        grid = cal.grid_of(F.col("_freq"))
        match = F.when(~grid.months & (grid.weekday < 0), F.col("most_common") * DAY == grid.step)
    elif expected and cal.is_plain_step(expected):
        match = F.col("most_common") * DAY == cal.grid_of(expected).step
    out = out.withColumn("expected_match", match)
    everyone = runs.rows.groupBy(*runs.keys).agg(F.sum("copies").alias("n_observations"))
    out = everyone.join(out, runs.keys, "left").withColumn(
        "error", F.when(F.col("n_observations") < 2, F.lit("Too few valid date values")))
    return runs.show(out, "n_observations", F.coalesce("n_deltas", F.lit(0)).alias("n_deltas"),
                     "most_common", "median_days",
                     F.coalesce("is_regular", F.lit(False)).alias("is_regular"), "expected_match", "error")


def gaps(runs: DateRuns) -> DataFrame:
    """keys, start, end, delta_days: steps longer than twice the median step."""
    hist = delta_histogram(runs)
    by = W.partitionBy(*runs.keys)
    cum = F.sum("n").over(by.orderBy("delta_days").rowsBetween(W.unboundedPreceding, 0))
    ranked = hist.withColumn("_cum", cum).withColumn("_tot", F.sum("n").over(by))
    pick = lambda pos: F.max(F.when((F.col("_cum") > pos) & (F.col("_cum") - F.col("n") <= pos),
                                    F.col("delta_days")))
    low, high = F.floor((F.col("_tot") - 1) / 2), F.ceil((F.col("_tot") - 1) / 2)
    medians = ranked.groupBy(*runs.keys).agg(((pick(low) + pick(high)) / 2.0).alias("median_days"))
    steps = attach_by_chunk(runs.rows.where("prev IS NOT NULL"), medians, runs.keys)
    days = F.bround(_delta() / F.lit(float(DAY)), 0).cast("bigint")
    return runs.show(steps.withColumn("delta_days", days).where("delta_days > 2 * median_days"),
                     F.col("prev").alias("start"), F.col("ts").alias("end"), "delta_days")


def infer_frequency(runs: DateRuns) -> DataFrame:
    """keys, start, end, n, freq_exact, freq_fallback, freq, seasonal_period, error.

    ``freq_exact`` is set when the dates are exactly regular and unique: a fixed
    step (``D``, ``2h``, ``W-MON``), month, quarter or year starts or ends, or
    business days. Otherwise the most common step in whole days decides.
    """
    ts, prev = F.col("ts"), F.col("prev")
    delta = _delta()
    months = (F.year(ts) * 12 + F.month(ts)) - (F.year(prev) * 12 + F.month(prev))
    weekday = F.weekday(ts)
    is_step = prev.isNotNull()
    work_day = F.when(is_step, F.when(weekday == 0, delta == 3 * DAY).otherwise(
        (weekday <= 4) & (delta == DAY)))
    day = F.to_date(ts)
    facts = runs.rows.groupBy(*runs.keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("copies").alias("n"),
        F.max("copies").alias("copies"),
        F.min(delta).alias("d_lo"), F.max(delta).alias("d_hi"),
        F.min(months).alias("m_lo"), F.max(months).alias("m_hi"),
        F.min(F.when(is_step, F.year(ts) - F.year(prev))).alias("y_lo"),
        F.max(F.when(is_step, F.year(ts) - F.year(prev))).alias("y_hi"),
        (F.min(F.month(ts)) == F.max(F.month(ts))).alias("one_month"),
        F.bool_and(F.dayofmonth(ts) == 1).alias("all_first"),
        F.bool_and(day == F.last_day(day)).alias("all_last"),
        F.bool_and(work_day).alias("work_days"))

    def counted(count: Column, name: Column) -> Column:
        return F.when(count == 1, name).otherwise(F.concat(count.cast("bigint").cast("string"), name))

    edge = F.when(F.col("all_first"), F.lit("S")).when(F.col("all_last"), F.lit("E"))
    start_month = F.month("start")
    quarter_month = cal.month_name(F.element_at(F.array(F.lit(12), F.lit(10), F.lit(11)),
                                                F.pmod(start_month, F.lit(3)).cast("int") + 1))
    same_months, same_years = F.col("m_lo") == F.col("m_hi"), F.col("y_lo") == F.col("y_hi")
    by_day = F.col("d_lo") % DAY == 0
    unique = F.col("d_lo") == F.col("d_hi")
    days = F.col("d_lo") / DAY
    year = F.when(edge.isNotNull() & same_years & F.col("one_month") & (F.col("y_lo") > 0), counted(
        F.col("y_lo"), F.concat(F.lit("Y"), edge, F.lit("-"), cal.month_name(start_month))))
    quarter = F.when(edge.isNotNull() & same_months & (F.col("m_lo") > 0) & (F.col("m_lo") % 3 == 0),
                     counted(F.col("m_lo") / 3, F.concat(F.lit("Q"), edge, F.lit("-"), quarter_month)))
    month = F.when(edge.isNotNull() & same_months & (F.col("m_lo") > 0),
                   counted(F.col("m_lo"), F.concat(F.lit("M"), edge)))
    week = F.when(unique & (days % 7 == 0), counted(
        days / 7, F.concat(F.lit("W-"), cal.weekday_name(F.col("start")))))
    plain = F.when(unique, counted(days, F.lit("D")))
    business = F.when(F.col("work_days") & (F.col("d_hi") == 3 * DAY) & (F.col("d_lo") == DAY), F.lit("B"))
    below = F.lit(None).cast("string")
    for name in ("us", "ms", "s", "min", "h"):
        size = cal.UNITS[name]
        below = F.when(unique & (F.col("d_lo") % size == 0),
                       counted(F.col("d_lo") / size, F.lit(name))).otherwise(below)
    exact = F.when((F.col("n") >= 3) & (F.col("copies") == 1), F.when(
        by_day, F.coalesce(year, quarter, month, week, plain, business)).otherwise(below))

    mode = _delta_counts(runs).groupBy(*runs.keys, "whole_days").agg(F.sum("n").alias("n")).groupBy(
        *runs.keys).agg(F.max_by("whole_days", F.struct("n", -F.col("whole_days"))).alias("mode_days"))
    d = F.col("mode_days")
    fallback = (F.when(d == 1, "D").when(d == 7, "W").when(d.between(28, 31), "M")
                .when(d.between(89, 92), "Q").when(d.between(360, 370), "A"))
    out = facts.join(mode, runs.keys, "left").select(
        *runs.keys, "start", "end", "n", exact.alias("freq_exact"), fallback.alias("freq_fallback"))
    out = out.withColumn("freq", F.coalesce("freq_exact", "freq_fallback"))
    return runs.show(out, "start", "end", "n", "freq_exact", "freq_fallback", "freq",
                     cal.seasonal_period(F.col("freq")).alias("seasonal_period"),
                     F.when(F.col("n") < 2, F.lit("Not enough valid date values")).alias("error"))


def _with_start(runs: DateRuns) -> DataFrame:
    ends = runs.rows.groupBy(*runs.keys).agg(F.min("ts").alias("_start"), F.max("ts").alias("_end"))
    return attach_by_chunk(runs.rows, ends, runs.keys)


def _named(rows: DataFrame, freq: str | DataFrame, keys: list[str]) -> tuple[DataFrame, cal.Grid]:
    """``rows`` with the columns that their grid needs; a table of frequencies (keys, ``freq``) gives each key its own."""
    if isinstance(freq, str):
        return rows, cal.grid_of(freq)
    names = freq.select(*keys, F.col("freq").alias("_freq"))
    rows = attach_by_chunk(rows, names, keys) if "chunk" in rows.columns else rows.join(names, keys, "left")
    return rows, cal.grid_of(F.col("_freq"))


def _holes(runs: DateRuns, freq: str | DataFrame) -> tuple[DataFrame, cal.Grid]:
    """Neighbouring dates with the numbers _lo.._hi of the grid points strictly between them."""
    rows, grid = _named(_with_start(runs).where("prev IS NOT NULL"), freq, runs.keys)
    rows = cal.with_grid(rows, grid, "_start")
    rows = cal.with_index(cal.with_index(rows, grid, "prev", "_from"), grid, "ts", "_to")
    return rows.withColumn("_lo", F.greatest(F.col("_from") + 1, F.lit(0))).withColumn(
        "_hi", F.col("_to") - F.col("_to_hit").cast("int")).where("_hi >= _lo"), grid


def _grid_columns(df: DataFrame) -> list[str]:
    return [c for c in ("_grid", "_tod", "_freq") if c in df.columns]


def missing_dates(runs: DateRuns, freq: str | DataFrame) -> DataFrame:
    """keys, missing_ts: grid points between first and last date that do not occur.

    Every missing point lies between two neighbouring dates, so each gap lists
    its own points and no full grid is built or joined. ``freq`` names one
    frequency, or is a table of one per key (keys, ``freq``); keys without a
    known frequency have no grid.
    """
    holes, grid = _holes(runs, freq)
    points = explode_range(holes.select(*runs.keys, *_grid_columns(holes), "_lo", "_hi"), F.col("_lo"), F.col("_hi"), "_k")
    return runs.show(points, cal.grid_point(grid, F.col("_k")).alias("missing_ts"))


def missing_date_counts(runs: DateRuns, freq: str | DataFrame) -> DataFrame:
    """keys, start, end, frequency, missing_count, expected_length, actual_length (counted, not listed).

    ``freq`` as for :func:`missing_dates`; counts are null for keys without a known frequency.
    """
    ends = runs.rows.groupBy(*runs.keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("actual_length"))
    ends, grid = _named(ends, freq, runs.keys)
    ends = cal.with_index(cal.with_grid(ends, grid, "start"), grid, "end", "_k")
    missing = _holes(runs, freq)[0].groupBy(*runs.keys).agg(F.sum(F.col("_hi") - F.col("_lo") + 1).alias("m"))
    out = ends.join(missing, runs.keys, "left")
    known = grid.step.isNotNull()
    return runs.show(out, "start", "end", (F.lit(freq) if isinstance(freq, str) else F.col("_freq")).alias("frequency"),
                     F.when(known, F.coalesce("m", F.lit(0))).cast("bigint").alias("missing_count"),
                     F.when(known, F.greatest(F.col("_k") + 1, F.lit(0))).cast("bigint").alias("expected_length"),
                     "actual_length")


GAP_ACTIONS = ["ignore", "forward_fill", "interpolate", "drop"]


def fill_gaps(df: DataFrame, date: str, value: str, freq: str | DataFrame, action: str = "forward_fill",
              keys: list[str] | None = None) -> DataFrame:
    """keys, ts, y, is_filled: the series with its missing grid points treated as asked.

    ``ignore`` lists the missing points without a value, ``drop`` leaves them
    out, ``forward_fill`` repeats the value before the gap and ``interpolate``
    draws a straight line over time. On repeated dates the mean counts. ``freq``
    as for :func:`missing_dates`.
    """
    if action not in GAP_ACTIONS:
        raise ValueError(f"unknown action: {action}")
    keys = list(keys or [])
    inner = keys or ["_table"]
    long = df.select(*keys, to_moment(df, date).cast("timestamp_ntz").alias("ts"),
                     to_number(df, value).alias("y")).dropna()
    if not keys:
        long = long.withColumn("_table", F.lit(0))
    means = long.groupBy(*inner, "ts").agg(F.avg("y").alias("y"))
    actual = means.select(*keys, "ts", "y", F.lit(False).alias("is_filled"))
    if action == "drop":
        return actual
    runs = DateRuns(write_table(ranked_runs(means.select(*inner, "ts"), inner, ["ts"])), inner, inner)
    holes, grid = _holes(runs, freq)
    # Values at both ends of a hole: (key, date) is unique on both sides.
    ends = means.select(*inner, F.col("ts").alias("_at"), "y")
    holes = holes.join(ends.select(*inner, F.col("_at").alias("prev"), F.col("y").alias("_y0")),
                       [*inner, "prev"]).join(
        ends.select(*inner, F.col("_at").alias("ts"), F.col("y").alias("_y1")), [*inner, "ts"])
    points = explode_range(holes.select(*inner, "prev", "ts", *_grid_columns(holes), "_y0", "_y1", "_lo", "_hi"),
                           F.col("_lo"), F.col("_hi"), "_k")
    points = points.withColumn("_g", cal.grid_point(grid, F.col("_k")))
    share = (micros(F.col("_g")) - micros(F.col("prev"))) / (micros(F.col("ts")) - micros(F.col("prev")))
    fill = {"ignore": F.lit(None).cast("double"), "forward_fill": F.col("_y0"),
            "interpolate": F.col("_y0") + (F.col("_y1") - F.col("_y0")) * share}[action]
    return actual.unionByName(points.select(*keys, F.col("_g").alias("ts"), fill.alias("y"),
                                            F.lit(True).alias("is_filled")))
