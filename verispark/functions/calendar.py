"""Time columns.  All timestamps are naive UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meteorological seasons by month.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def valid_day(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def season(timestamp: Column) -> Column:
    """Season label of the calendar month; December joins the same year's January."""
    label = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        label = F.when(F.month(timestamp).isin(*months), F.lit(name)).otherwise(label)
    return label


def add_hours(timestamp: Column, hours: Column) -> Column:
    return timestamp + F.make_dt_interval(hours=hours.cast("int"))


def decode_offset(value: Column, unit: str, origin: str) -> Column:
    """``value`` counted in ``unit`` since ``origin``, as an archive encodes its time axis."""
    seconds = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}[unit]
    return F.lit(origin).cast("timestamp_ntz") + F.make_dt_interval(secs=(value * seconds).cast("decimal(18,6)"))


def lead_to_hours(value: Column, unit: str) -> Column:
    factor = {"hours": 1.0, "hour": 1.0, "minutes": 1 / 60, "seconds": 1 / 3600}[unit.lower()]
    return value * factor


def cycle_hour(valid_hour: Column, lead_h: Column) -> Column:
    """Initialisation hour that verifies at ``valid_hour`` after ``lead_h`` hours."""
    return F.pmod(valid_hour - lead_h, F.lit(24))


def is_leap_day(timestamp: Column) -> Column:
    return (F.month(timestamp) == 2) & (F.dayofmonth(timestamp) == 29)


def in_leap_year(timestamp: Column) -> Column:
    year = F.year(timestamp)
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def year_window(timestamp: Column, year: int, halo_days: int = 0) -> Column:
    """Half-open window of one calendar year, widened by whole days on both sides."""
    low = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(halo_days))
    high = F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(halo_days))
    return (timestamp >= low) & (timestamp < high)


def day_window(day: Column, first: str, last: str, halo_days: int = 0) -> Column:
    """Days from ``first`` to ``last``, widened by whole days on both sides; a bound on a partition column prunes its folders."""
    low, high = (dt.date.fromisoformat(d) + dt.timedelta(days=sign * halo_days) for d, sign in ((first, -1), (last, 1)))
    return day.between(F.lit(low), F.lit(high))


def overlaps_year(start: Column, end: Column, year: int) -> Column:
    """A segment [start, end] touches ``year``; an open end is NULL."""
    first = F.lit(f"{year}-01-01").cast("date")
    last = F.lit(f"{year}-12-31").cast("date")
    return (start <= last) & (end.isNull() | (end >= first))


def open_ended_date(text: Column, open_token: str = "9999-99-99") -> Column:
    """Date text in which one token stands for 'still open' and bad text is missing."""
    return F.nullif(F.trim(text), F.lit(open_token)).try_cast("date")
