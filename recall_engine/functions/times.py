"""Calendar features and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: timestamp pattern of the try log.
TRY_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def parse_time(text: Column) -> Column:
    return F.to_timestamp(text, TRY_TIME)


def iso_week(time: Column) -> Column:
    return F.weekofyear(time)


def iso_weekday(time: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(time) + 1


def hour_of_day(time: Column) -> Column:
    return F.hour(time)


def trial_hours(start: Column, end: Column) -> Column:
    """Hours between two times with whole days dropped, as the seconds part of an interval gives."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.pmod(F.floor(micros / F.lit(1_000_000)), F.lit(86_400)) / F.lit(3600.0)
