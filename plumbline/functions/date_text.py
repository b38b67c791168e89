"""Dates in text: the shape of a value says how its fields are ordered, and each shape is parsed by its own rule.

Values are read in batches of Arrow arrays: one pattern per shape finds the fields, arithmetic on whole columns makes the dates.
Shapes are told apart by character classes (digits, letters, separators). Within a column, the order of day and month in
``5/1/2020`` is settled by the largest numbers its values hold, since only a day can exceed 12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, weekday names, where two-digit years turn over, and how long a date may be.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
TURN = 69
SHORTEST, LONGEST = 5, 46

_NAME, _DAY, _YEAR = r"(?P<m>[A-Za-z]{3,9})", r"(?P<d>[0-9]{1,2})(?:st|nd|rd|th)?", r"(?P<y>[0-9]{4}|[0-9]{2})"
_BREAKS = r"(?P<b1>[-/.])", r"(?P<b2>[-/.])"
# Shape -> pattern of the date with the places of year, month and day; both breaks have to be the same.
SHAPES = {
    "y-m-d": rf"(?P<y>[0-9]{{4}}){_BREAKS[0]}(?P<m>[0-9]{{1,2}}){_BREAKS[1]}(?P<d>[0-9]{{1,2}})",
    "yyyymmdd": r"(?P<y>(?:1[6-9]|2[0-2])[0-9]{2})(?P<m>0[1-9]|1[0-2])(?P<d>[0-9]{2})",
    "y-m": r"(?P<y>[0-9]{4})[-/](?P<m>[0-9]{1,2})",
    "n-n-y": rf"(?P<m>[0-9]{{1,2}}){_BREAKS[0]}(?P<d>[0-9]{{1,2}}){_BREAKS[1]}{_YEAR}",
    "d name y": rf"{_DAY}[ -]{_NAME}\.?,?[ -]{_YEAR}",
    "name d y": rf"{_NAME}\.? {_DAY},? (?P<y>[0-9]{{4}})",
    "name y": rf"{_NAME}\.?,?[ -](?P<y>[0-9]{{4}})",
}
EITHER = "n-n-y"     # day and month in either order
_CLOCK = r"(?P<hour>[0-9]{1,2}):(?P<minute>[0-9]{2})(?::(?P<second>[0-9]{2})(?:[.,](?P<part>[0-9]{1,9}))?)?(?: ?(?P<half>[AaPp])[Mm])?"
_ZONE = r" ?(?:Z|UTC|GMT|(?P<sign>[+-])(?P<zh>[0-9]{2}):?(?P<zm>[0-9]{2})?)"
_TIME = rf"(?:(?:[T ]| at ) ?{_CLOCK}(?:{_ZONE})?)?"
_WEEKDAY = "^(?:" + "|".join("".join(f"[{x.upper()}{x}]" for x in day) for day in WEEKDAYS) + r")[A-Za-z]*\.?,? +"
_LINE_END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])$"
# What a month may be called: in full, or by three letters at least.
_MONTHS = {name[:k]: i + 1 for i, name in enumerate(MONTH_NAMES) for k in range(3, len(name) + 1)}
# Dates without a day have no time either.
_PATTERNS = {shape: f"^{date}{_TIME if '(?P<d>' in date else ''}$" for shape, date in SHAPES.items()}


def _numbers(fields: pa.StructArray, name: str) -> np.ndarray:
    """A field as numbers, 0 where it is not there."""
    if fields.type.get_field_index(name) < 0:
        return np.zeros(len(fields), np.int64)
    text = fields.field(name)
    return pc.if_else(pc.equal(text, ""), "0", text).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _texts(fields: pa.StructArray, name: str) -> pa.Array:
    return fields.field(name) if fields.type.get_field_index(name) >= 0 else pa.array([""] * len(fields), pa.string())


def _moments(year: np.ndarray, month: np.ndarray, day: np.ndarray, micros: np.ndarray, sound: np.ndarray) -> pa.Array:
    """Moments without time zone; null for days that are not in the calendar."""
    sound = sound & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    first = ((year - 1970) * 12 + np.where(sound, month, 1) - 1).astype("datetime64[M]")
    days = first.astype("datetime64[D]") + (np.where(sound, day, 1) - 1)
    sound = sound & (days.astype("datetime64[M]") == first)
    return pa.array(days.astype(np.int64) * 86_400_000_000 + micros, mask=~sound).cast(pa.timestamp("us"))


def _moments_of(shape: str, fields: pa.StructArray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(month first, day first, month, day) of texts of one shape; month 0 is an unknown name."""
    year = _numbers(fields, "y")
    short = np.asarray(pc.utf8_length(fields.field("y"))) <= 2
    year = np.where(short, year + np.where(year >= TURN, 1900, 2000), year)
    if "name" in shape:
        found = pc.index_in(pc.ascii_lower(fields.field("m")), value_set=pa.array(list(_MONTHS)))
        month = np.array([*_MONTHS.values(), 0])[pc.fill_null(found, -1).to_numpy(zero_copy_only=False)]
    else:
        month = _numbers(fields, "m")
    day = _numbers(fields, "d") if "(?P<d>" in SHAPES[shape] else np.ones(len(fields), np.int64)
    hour, minute, second = (_numbers(fields, x) for x in ("hour", "minute", "second"))
    part = pc.utf8_slice_codeunits(pc.utf8_rpad(_texts(fields, "part"), 6, "0"), 0, 6).cast(pa.int64()).to_numpy(zero_copy_only=False)
    half = pc.ascii_lower(_texts(fields, "half"))
    halved, late = np.asarray(pc.not_equal(half, "")), np.asarray(pc.equal(half, "p"))
    sound = ~halved | ((hour >= 1) & (hour <= 12))
    hour = np.where(halved, hour % 12 + 12 * late, hour)
    # Second 60 is the start of the next minute.
    sound = sound & (hour <= 23) & (minute <= 59) & ((second <= 59) | ((second == 60) & (part == 0)))
    away = (_numbers(fields, "zh") * 60 + _numbers(fields, "zm")) * np.where(np.asarray(pc.equal(_texts(fields, "sign"), "-")), -1, 1)
    micros = (((hour * 60 + minute - away) * 60) + second) * 1_000_000 + part
    ahead = _moments(year, month, day, micros, sound)
    return ahead, _moments(year, day, month, micros, sound) if shape == EITHER else ahead, month, day


def _candidates(texts: pa.Array) -> dict[str, np.ndarray]:
    """For every shape the texts that may have it by their first characters."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    first = data[np.minimum(ends[:-1, None] + np.arange(5), len(data) - 1)]
    digit = (first >= ord("0")) & (first <= ord("9"))
    letter, broken = ~digit[:, 0], np.isin(first, [ord(x) for x in "-/."])
    year = digit[:, :4].all(1)
    # One or two digits, a break and another digit.
    pair = (digit[:, 0] & broken[:, 1] & digit[:, 2]) | (digit[:, :2].all(1) & broken[:, 2] & digit[:, 3])
    other = ~letter & ~year & ~pair
    return {"y-m-d": year & broken[:, 4], "yyyymmdd": year & digit[:, 4], "y-m": year & broken[:, 4], "n-n-y": pair,
            "d name y": other, "name d y": letter, "name y": letter}


READ = "struct<shape:string,month_first:timestamp_ntz,day_first:timestamp_ntz,one:int,two:int>"


def read_texts(texts: pa.Array) -> pa.StructArray:
    """How texts read as dates: shape, month_first, day_first, one, two; see :func:`readings`."""
    n = len(texts)
    bare = pc.replace_substring_regex(pc.utf8_trim(texts.cast(pa.string()), " "), _WEEKDAY, "", max_replacements=1)
    bare = pc.replace_substring_regex(bare, _LINE_END, "", max_replacements=1)
    size = pc.utf8_length(bare)
    fits = pc.fill_null(pc.and_(pc.greater_equal(size, SHORTEST), pc.less_equal(size, LONGEST)), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    open_ = bare.take(pa.array(at))
    found, rows = [], []
    maybe = _candidates(open_) if len(at) else {}
    done = np.zeros(len(at), bool)
    for shape, pattern in _PATTERNS.items():
        look = np.flatnonzero(maybe[shape] & ~done) if maybe else []
        if not len(look):
            continue
        fields = pc.extract_regex(open_ if len(look) == len(at) else open_.take(pa.array(look)), pattern)
        hit = fields.is_valid()
        if "b1" in pattern:
            hit = pc.and_(hit, pc.fill_null(pc.equal(pc.struct_field(fields, "b1"), pc.struct_field(fields, "b2")), False))
        hits = hit.to_numpy(zero_copy_only=False)
        if not hits.any():
            continue
        some = fields.filter(hit)
        ahead, swapped, one, two = _moments_of(shape, pa.StructArray.from_arrays(some.flatten(), fields=list(some.type)))
        leads = shape == EITHER
        found.append(pa.StructArray.from_arrays([
            pa.array([shape]).take(pa.array(np.zeros(len(one), np.int64))), ahead, swapped,
            pa.array(one if leads else np.zeros(len(one), np.int64), pa.int32(), mask=np.full(len(one), not leads)),
            pa.array(two if leads else np.zeros(len(two), np.int64), pa.int32(), mask=np.full(len(two), not leads))],
            ["shape", "month_first", "day_first", "one", "two"]))
        done[look[hits]] = True
        rows.append(at[look[hits]])
    place = np.full(n, -1)
    if rows:
        place[np.concatenate(rows)] = np.arange(sum(map(len, rows)))
    kind = pa.struct([("shape", pa.string()), ("month_first", pa.timestamp("us")), ("day_first", pa.timestamp("us")), ("one", pa.int32()), ("two", pa.int32())])
    every = pa.concat_arrays(found) if found else pa.array([], kind)
    # Fields are null where nothing was read; the struct itself never is.
    take = pa.array(place, mask=place < 0)
    return pa.StructArray.from_arrays([every.field(i).take(take) for i in range(len(kind))], fields=list(kind))


def _read(text: Column) -> Column:
    @F.arrow_udf(READ)
    def read(values: pa.Array) -> pa.Array:
        return read_texts(values)

    return read(text)


def readings(df: DataFrame, texts: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns, and for each of ``texts`` a struct: shape, month_first, day_first, one, two.

    How a text reads as a date with either order of day and month: moments without time zone (UTC where the text has an
    offset), null for impossible dates; ``one`` and ``two`` are the leading numbers of text like ``5/1/2020``.
    """
    return df.select(*[e.alias(c) for c, e in keep.items()], *[_read(t).alias(c) for c, t in texts.items()])


def date_of(text: Column, day_first: bool = False) -> Column:
    """The moment that a text reads as; see :func:`readings`."""
    return _read(text)["day_first" if day_first else "month_first"]
