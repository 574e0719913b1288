"""Time as columns. Unix seconds are UTC; tz_offset is seconds to add for local time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import SECONDS

_OFFSET = r"([+-]\d{2}:?\d{2}|Z)$"


def step_seconds(periods: int, freq: str) -> int:
    """Seconds of a bin: periods of s, min, h, d or w."""
    return int(periods) * SECONDS[freq.lower()]


def literal_seconds(value) -> int:
    """Unix seconds of a number, an ISO string or a datetime; without a zone it is UTC."""
    if isinstance(value, (int, float)):
        return int(value)
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return int((value if value.tzinfo else value.replace(tzinfo=dt.UTC)).timestamp())


def offset_of(text: Column) -> Column:
    """Seconds of an offset at the end of a time string; Z is 0, none is null."""
    found = F.regexp_extract(text, _OFFSET, 1)
    digits = F.regexp_replace(found, ":", "")
    seconds = (F.substring(digits, 2, 2).try_cast("long") * 3600 + F.substring(digits, 4, 2).try_cast("long") * 60) * F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    return F.when(found == "Z", F.lit(0).cast("long")).when(found != "", seconds)


def naive_of(text: Column) -> Column:
    """The local time of a time string, its offset dropped."""
    return F.try_to_timestamp(F.regexp_replace(text, _OFFSET, "")).cast("timestamp_ntz")


def offset_string(offset: Column) -> Column:
    """Seconds as ±HH:MM; the sign is that of the whole offset."""
    size = F.abs(offset)
    sign = F.when(offset < 0, "-").otherwise("+")
    return F.when(offset.isNotNull(), F.format_string("%s%02d:%02d", sign, F.floor(size / 3600).cast("long"), F.floor(F.pmod(size, F.lit(3600)) / 60).cast("long")))


def unix_of(time: Column, kind: str, tz_offset: Column | None = None) -> Column:
    """Unix seconds of a column of a Spark type: numbers as they are, local times less their offset, strings by row."""
    if kind in ("bigint", "int", "double", "float"):
        return F.floor(time).cast("long")
    if kind == "string":
        naive = F.unix_seconds(naive_of(time).cast("timestamp"))
        own = offset_of(time)
        given = tz_offset if tz_offset is not None else F.lit(0)
        return naive - F.coalesce(own, given, F.lit(0))
    seconds = F.unix_seconds(time.cast("timestamp"))
    if kind == "timestamp_ntz" and tz_offset is not None:
        return seconds - F.coalesce(tz_offset, F.lit(0))
    return seconds


def local_ntz(seconds: Column, tz_offset: Column | None = None) -> Column:
    """Local wall time of Unix seconds."""
    shifted = seconds if tz_offset is None else seconds + F.coalesce(tz_offset, F.lit(0))
    return F.timestamp_seconds(shifted).cast("timestamp_ntz")


def zoned_string(seconds: Column, tz_offset: Column) -> Column:
    """Local wall time with its offset, as text."""
    return F.concat(F.date_format(local_ntz(seconds, tz_offset), "yyyy-MM-dd HH:mm:ss"), offset_string(tz_offset))


def yyyymmdd(seconds: Column, tz_offset: Column | None = None) -> Column:
    return F.date_format(local_ntz(seconds, tz_offset), "yyyyMMdd").cast("int")


def bin_of(seconds: Column, step: int) -> Column:
    """The number of a bin of step seconds; floors below zero too."""
    return F.floor(seconds / F.lit(step)).cast("long")


def floor_minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("long")


#: How bins are written, by frequency.
FORMATS = {"s": "yyyy-MM-dd HH:mm:ss", "min": "yyyy-MM-dd HH:mm", "h": "yyyy-MM-dd HH:00", "d": "yyyy-MM-dd", "w": "yyyy-MM-dd"}


def bin_label(seconds: Column, freq: str) -> Column:
    return F.date_format(local_ntz(seconds), FORMATS[freq.lower()])
