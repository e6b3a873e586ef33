"""Quality flags, unit conversions and sentinels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD_GRAVITY = 9.80665


def missing_to_null(value: Column) -> Column:
    """NaN means missing in the source data; NULL means missing in Spark."""
    return F.nanvl(value, F.lit(None).cast("double"))


def in_range(value: Column, low: float, high: float) -> Column:
    return value.between(F.lit(low), F.lit(high))


def mask_flag(mask: Column, required: str = "1") -> Column:
    """First entry of a bracketed flag list such as ``[1 0 1]`` equals ``required``."""
    return F.regexp_extract(mask, r"^\[\s*([01])", 1) == F.lit(required)


def is_true(flag: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(flag, F.lit(False))


def keep_where(value: Column, condition: Column) -> Column:
    return F.when(condition, value)


def all_zero(*channels: Column) -> Column:
    """Every channel reads exactly zero: the logger was offline."""
    condition = F.lit(True)
    for channel in channels:
        condition = condition & (channel == 0)
    return is_true(condition)


def kelvin_to_celsius(value: Column) -> Column:
    return value - 273.15


def pascal_to_hpa(value: Column) -> Column:
    return value * 0.01


def kmh_to_ms(value: Column) -> Column:
    return value / 3.6


def geopotential_to_metres(value: Column) -> Column:
    return value / STANDARD_GRAVITY


def lapse_adjusted(value: Column, rate_k_per_km: float, delta_z_m: Column) -> Column:
    return value - rate_k_per_km * delta_z_m / 1000.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
