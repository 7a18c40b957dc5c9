"""Missing values, group keys, storage types and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Magnitude from which a number is missing; bounds of the storage types; days from 1960 to 1970.
BIG = 2.0**1023
BOUNDS = {"byte": (-127, 100), "int": (-32767, 32740), "long": (-2147483647, 2147483620)}
FLOAT_MAX = 1.7014117331926443e38
EPOCH_DAYS = 3653
EPOCH_MS = EPOCH_DAYS * 86_400_000
LONGEST_STR = 2045
STORAGE = {"byte": T.ByteType(), "int": T.ShortType(), "long": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType()}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def finite(c: Column) -> Column:
    """Missing for NaN, infinities and anything from 2^1023 on (NaN compares greater than every number)."""
    return F.when(F.abs(c) < F.lit(BIG), c)


def double(c: Column) -> Column:
    return c.cast("double")


def key_of(name: str, kind: T.DataType | None = None) -> Column:
    """A column as a key of groups and joins: '' and NaN are the one missing value."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, FRACTIONAL):
        return F.when(~F.isnan(c), c)
    return c


def present(c: Column, kind: str) -> Column:
    """Whether a value is not missing."""
    return F.coalesce(c != "", F.lit(False)) if kind == "s" else c.isNotNull()


def trunc(c: Column) -> Column:
    return F.when(F.abs(c) >= F.lit(2.0**53), c).otherwise(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double"))


def down(c: Column) -> Column:
    return F.when(F.abs(c) >= F.lit(2.0**53), c).otherwise(F.floor(c).cast("double"))


def up(c: Column) -> Column:
    return F.when(F.abs(c) >= F.lit(2.0**53), c).otherwise(F.ceil(c).cast("double"))


def first_bytes(c: Column, n: int) -> Column:
    """The first n bytes of a string; a split character becomes U+FFFD."""
    return F.when(F.octet_length(c) <= n, c).otherwise(F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string")))


def stored(c: Column, storage: str) -> Column:
    """A value as a storage type holds it: integers truncate, what is out of range is missing, strings are cut in bytes."""
    if storage in BOUNDS:
        lo, hi = BOUNDS[storage]
        t = trunc(double(c))
        return F.when(t.between(lo, hi), t).cast(STORAGE[storage])
    if storage == "float":
        return F.when(F.abs(double(c)) <= FLOAT_MAX, double(c)).cast("float")
    if storage == "double":
        return finite(double(c))
    if storage == "strL":
        return c
    m = re.fullmatch(r"str(\d+)", storage)
    if not m or not 1 <= int(m[1]) <= LONGEST_STR:
        raise ValueError(storage)
    return first_bytes(c, int(m[1]))


def is_storage(word: str) -> bool:
    return word in STORAGE or word == "strL" or bool(re.fullmatch(r"str([1-9]\d{0,3})", word)) and int(word[3:]) <= LONGEST_STR


def date_of_days(days: Column) -> Column:
    """DATE of a day count since 1960 (missing outside the years 1 to 9999)."""
    whole = F.when(days.between(-715_500, 2_936_500), F.floor(days)).cast("int")
    return F.date_add(F.lit("1960-01-01").cast("date"), whole)


def days_of(year: Column, month: Column, day: Column) -> Column:
    """Day count since 1960, missing for a date that does not exist."""
    whole = [F.when(F.abs(x) < 1e6, F.floor(x)).cast("int") for x in (year, month, day)]
    y, m, d = whole
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    ok = y.between(0, 9999) & m.between(1, 12) & (d >= 1) & (d <= longest)
    return F.datediff(F.when(ok, F.make_date(y, m, d)), F.lit("1960-01-01").cast("date")).cast("double")
