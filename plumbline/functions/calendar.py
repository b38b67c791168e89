"""Frequency names and date grids as column expressions.

A grid is described by a unit (a fixed number of microseconds, or months), a
step and an anchor. ``with_index`` numbers the last grid point at or before a
moment, ``grid_point`` turns a number back into a moment, so the points between
two neighbouring dates follow from two divisions and need no join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import micros

DAY = 86_400_000_000
# Names of weekdays and months inside frequency names.
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
# Microseconds per unit of fixed length.
UNITS = {"D": DAY, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
# Months per unit and whether the point is the start or the end of the month.
CALENDAR = {"MS": (1, "start"), "ME": (1, "end"), "M": (1, "end"), "QS": (3, "start"),
            "QE": (3, "end"), "Q": (3, "end"), "YS": (12, "start"), "AS": (12, "start"),
            "YE": (12, "end"), "A": (12, "end"), "Y": (12, "end")}
# Seasonal period per base letter of the frequency.
SEASONAL_PERIOD = {"D": 7, "W": 52, "M": 12, "Q": 4, "A": 1, "Y": 1}


@dataclass(frozen=True)
class Grid:
    """A grid as columns: literals for one frequency, expressions over a name column for one per row."""

    months: Column     # a step in months, not of a fixed length?
    step: Column       # microseconds or months
    anchor: Column     # months: month of the year 0..11
    at_end: Column     # months: is the point the end of the month?
    weekday: Column    # 0..6 for weekly grids, else -1


NAME = r"^(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?$"
# Older letters for units.
ALIASES = {"H": "h", "T": "min", "S": "s", "d": "D"}


def known_frequency(freq: str) -> bool:
    m = re.fullmatch(NAME, freq.strip())
    if not m:
        return False
    base, tail = m[2], m[3]
    if base == "W":
        return tail is None or tail in WEEKDAYS
    if base in CALENDAR:
        return tail is None or tail in MONTHS
    return ALIASES.get(base, base) in UNITS and tail is None


def is_plain_step(freq: str) -> bool:
    """A fixed number of microseconds from any start, like ``D`` or ``2h``."""
    return known_frequency(freq) and re.fullmatch(NAME, freq.strip())[2] not in {"W", *CALENDAR}


def grid_of(freq: str | Column) -> Grid:
    """``D``, ``2h``, ``W-SUN``, ``MS``, ``QS-OCT``, ``YE-DEC`` ... as a grid; a name column gives every row its own.

    Rows with an unknown name have null steps, hence no grid points.
    """
    if isinstance(freq, str):
        if not known_frequency(freq):
            raise ValueError(f"Frequency '{freq}' is not known")
        freq = F.lit(freq)
    name = F.trim(freq)
    count, base, tail = (F.regexp_extract(name, NAME, i) for i in (1, 2, 3))

    def look_up(table: dict, key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    count = F.coalesce(F.nullif(count, F.lit("")).try_cast("long"), F.lit(1))
    fixed = look_up(UNITS | {old: UNITS[new] for old, new in ALIASES.items()}, base)
    months = look_up({k: m for k, (m, _) in CALENDAR.items()}, base)
    at_end = F.coalesce(look_up({k: edge == "end" for k, (_, edge) in CALENDAR.items()}, base), F.lit(False))
    weekday = look_up({d: i for i, d in enumerate(WEEKDAYS)}, F.when(tail == "", "SUN").otherwise(tail))
    month = look_up({m: i for i, m in enumerate(MONTHS)}, F.when(tail != "", tail).otherwise(F.when(at_end, "DEC").otherwise("JAN")))
    weekly = base == "W"
    step = F.when(weekly & weekday.isNotNull(), count * 7 * DAY).when(months.isNotNull() & month.isNotNull(), count * months).when(
        tail == "", count * fixed)
    return Grid(months.isNotNull(), step, F.coalesce(month, F.lit(0)), at_end, F.when(weekly, weekday).otherwise(F.lit(-1)))


def _month_index(moment: Column) -> Column:
    return F.year(moment) * 12 + F.month(moment) - 1


def _time_of_day(moment: Column) -> Column:
    us = micros(moment)
    return us - F.floor(us / DAY) * DAY


def _month_point(grid: Grid, index: Column, time_of_day: Column) -> Column:
    day = F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    day = F.when(grid.at_end, F.last_day(day)).otherwise(day)
    return F.timestamp_add("MICROSECOND", time_of_day, day.cast("timestamp_ntz"))


def _past_point(grid: Grid, moment: Column, time_of_day: Column) -> Column:
    """Microseconds by which ``moment`` is past the point of its own month (negative: before)."""
    first = F.when(grid.at_end, F.dayofmonth(F.last_day(moment.cast("date")))).otherwise(1)
    return (F.dayofmonth(moment) - first) * F.lit(DAY) + _time_of_day(moment) - time_of_day


def with_grid(df: DataFrame, grid: Grid, start: str) -> DataFrame:
    """Add ``_tod`` and ``_grid``: time of day and number of the first grid point from ``start`` on."""
    at = F.col(start)
    df = df.withColumn("_tod", _time_of_day(at))
    ahead = F.when(grid.weekday >= 0, F.pmod(grid.weekday - F.weekday(at), F.lit(7)) * F.lit(DAY)).otherwise(0)
    # Quarters and years have their own months; other steps begin with the month at hand.
    unit = F.when(grid.step % 12 == 0, 12).when(grid.step % 3 == 0, 3).otherwise(1)
    df = df.withColumn("_m", _month_index(at))
    df = df.withColumn("_aligned", F.col("_m") + F.pmod(grid.anchor - F.col("_m"), unit))
    late = (F.col("_aligned") == F.col("_m")) & (_past_point(grid, at, F.col("_tod")) > 0)
    by_month = F.col("_aligned") + F.when(late, unit).otherwise(0)
    return df.withColumn("_grid", F.when(grid.step.isNotNull(), F.when(grid.months, by_month).otherwise(micros(at) + ahead))).drop("_m", "_aligned")


def with_index(df: DataFrame, grid: Grid, moment: str, name: str) -> DataFrame:
    """Add ``name``: number of the last grid point at or before ``moment`` (-1 before the
    first), and ``name_hit``: whether the moment is that point."""
    at = F.col(moment)
    df = df.withColumn("_away", F.when(grid.months, _month_index(at)).otherwise(micros(at)) - F.col("_grid")).withColumn(
        "_past", F.when(grid.months, _past_point(grid, at, F.col("_tod"))).otherwise(0))
    own = F.col("_away") % grid.step == 0
    return df.withColumn(name, F.floor(F.col("_away") / grid.step) - F.when(
        own & (F.col("_past") < 0), 1).otherwise(0)).withColumn(
        f"{name}_hit", own & (F.col("_past") == 0)).drop("_away", "_past")


def grid_point(grid: Grid, k: Column) -> Column:
    """Moment of grid point ``k``; needs the columns of :func:`with_grid`."""
    at = F.col("_grid") + k * grid.step
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # Each branch gets a number it can hold.
    fixed = F.timestamp_add("MICROSECOND", F.when(~grid.months, at).otherwise(0), epoch)
    return F.when(grid.months, _month_point(grid, F.when(grid.months, at).otherwise(0), F.col("_tod"))).otherwise(fixed)


def seasonal_period(freq: Column) -> Column:
    """Seasonal period of a frequency name; ``MS``, ``ME``, ``W-SUN`` ... count as their base letter."""
    base = F.upper(F.regexp_extract(freq, "^([A-Za-z])", 1))
    exact = F.regexp_extract(freq, "^(D|W(-[A-Z]{3})?|M|MS|ME|Q|QS|QE|A|Y|YS|YE|AS)(-[A-Z]{3})?$", 0)
    out = F.lit(None).cast("int")
    for letter, period in SEASONAL_PERIOD.items():
        out = F.when((exact != "") & (base == letter), F.lit(period)).otherwise(out)
    return out


def weekday_name(moment: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(moment) + 1)


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), number.cast("int"))
