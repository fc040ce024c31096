"""Times, stamps and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC time, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_local_date(seconds: Column, zone: str) -> Column:
    """Calendar date in a zone of seconds since 1970."""
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def parse_stamp(text: Column, *formats: str) -> Column:
    """First of the formats that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def slot_of(ts: Column, minutes: int = 15) -> Column:
    """Minute of the day, floored to the grid."""
    return (F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes).cast("int")


def slot_minutes(per_day: int, offset: int = 0, grid: int = 15) -> Column:
    """Evenly spaced minutes of the day on the grid, wrapped at 24 hours, each once and in order."""
    each = F.sequence(F.lit(0), F.lit(per_day - 1))
    return F.array_sort(F.array_distinct(F.transform(each, lambda i: (F.floor((i * (1440.0 / per_day) + offset) / grid) * grid % 1440).cast("int"))))


def slot_stamps(day: Column, per_day: int, offset: int = 0) -> Column:
    """Stamps yyyyMMddHHmmss of a day's slots."""
    text = F.date_format(day, "yyyyMMdd")
    return F.transform(slot_minutes(per_day, offset), lambda m: F.concat(text, F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("00")))


def date_grid(start: Column, end: Column, stride: int = 1) -> Column:
    return F.sequence(start, end, F.make_dt_interval(F.lit(stride)))
