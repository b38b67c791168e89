"""Column roles by type, and casts that never fail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.date_text import date_of

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def columns_of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, (T.StringType,))


def nested_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NESTED)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL in float and double columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name))
        else:
            cols.append(q(f.name))
    return df.select(*cols)


def to_number(df: DataFrame, name: str) -> Column:
    """Value as double; text that is no number and NaN become NULL."""
    x = q(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_moment(df: DataFrame, name: str, formats: Iterable[str] = (), day_first: bool = False) -> Column:
    """Value as timestamp; text that is no date becomes NULL. ``formats`` are tried first."""
    kind = type_of(df, name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return q(name)
    if isinstance(kind, T.DateType):
        return q(name).cast("timestamp_ntz")
    text = q(name).cast("string")
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    cast = text.try_cast("timestamp_ntz")
    # Plain ISO text takes the short way; a cast would pass over an offset from UTC.
    tries += [F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ][0-9:.]+)?$"), cast), date_of(text, day_first), cast]
    return F.coalesce(*tries)


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)
