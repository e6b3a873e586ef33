"""Archive checks.  Each check becomes one finding row; a check that cannot decide says ``unknown``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import in_leap_year, is_leap_day
from .order_stats import grouped_quantiles


# The names of the checks and the severities pass, warn, fail and unknown are fixed values of the result.

def _finding(check: str, severity: Column, value: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), severity.alias("severity"), value.cast("double").alias("detail"))


def _verdict(bad: Column, level: str = "fail") -> Column:
    return F.when(bad > 0, level).otherwise("pass")


def coordinate_findings(stations: DataFrame) -> DataFrame:
    """Missing, out-of-range, swapped and null-island coordinates in one pass."""
    lat, lon = F.col("latitude"), F.col("longitude")
    counts = stations.agg(
        F.count_if(lat.isNull() | lon.isNull()).alias("missing"),
        F.count_if((F.abs(lat) > 90) | (F.abs(lon) > 180)).alias("outside"),
        F.count_if((F.abs(lat) > 90) & (F.abs(lat) <= 180)).alias("swapped"),
        F.count_if((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)).alias("origin"))
    return counts.select(F.inline(F.array(
        _finding("coordinates_present", _verdict(F.col("missing")), F.col("missing")),
        _finding("coordinates_in_range", _verdict(F.col("outside")), F.col("outside")),
        _finding("coordinates_not_swapped", _verdict(F.col("swapped")), F.col("swapped")),
        _finding("coordinates_not_null_island", _verdict(F.col("origin"), "warn"), F.col("origin")))))


def elevation_findings(stations: DataFrame, column: str = "altitude_m") -> DataFrame:
    """Elevation present, between the lowest shore and the highest peak, and not a zero sentinel."""
    if column not in stations.columns:
        return stations.sparkSession.range(1).select(F.inline(F.array(
            _finding("elevation_present", F.lit("fail"), F.lit(None)))))
    z = F.col(column)
    counts = stations.agg(
        F.count_if(z.isNull()).alias("missing"), F.count_if((z < -430) | (z > 8850)).alias("impossible"),
        F.count_if(z == 0).alias("zero"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.inline(F.array(
        _finding("elevation_present", _verdict(F.col("missing")), F.col("missing")),
        _finding("elevation_plausible", _verdict(F.col("impossible")), F.col("impossible")),
        _finding("elevation_not_sentinel_zero",
                 F.when(F.col("zero") > F.col("n") * 0.02, "warn").otherwise("pass"), F.col("zero")))))


def timestamp_findings(df: DataFrame, time: str, series: str | None = None,
                       expected_hours: Sequence[int] = ()) -> DataFrame:
    """Declared zone, uniqueness per series, expected hours and the leap day."""
    aware = dict(df.dtypes)[time] == "timestamp"
    keys = [c for c in (series, time) if c]
    # Repeats are counted through pre-aggregated keys, not by comparing rows.
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    odd = ~F.hour(time).isin(*expected_hours) if expected_hours else F.lit(False)
    counts = groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"), F.sum(F.when(odd, F.col("_n")).otherwise(0)).alias("odd"),
        F.sum(F.when(is_leap_day(F.col(time)), F.col("_n")).otherwise(0)).alias("leap"),
        F.max(in_leap_year(F.col(time))).alias("spans"))
    rows = [
        _finding("timestamps_timezone_declared", F.lit("pass" if aware else "warn"), F.lit(float(aware))),
        _finding("timestamps_unique", _verdict(F.col("repeats")), F.col("repeats")),
        _finding("timestamps_leap_day",
                 F.when((F.col("leap") > 0) | ~F.col("spans"), "pass").otherwise("warn"), F.col("leap"))]
    if expected_hours:
        rows.insert(2, _finding("timestamps_expected_hours", _verdict(F.col("odd")), F.col("odd")))
    return counts.select(F.inline(F.array(*rows)))


def temperature_unit_finding(df: DataFrame, value: str) -> DataFrame:
    """Celsius, kelvin or Fahrenheit, judged by the median."""
    clean = df.select(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    median = grouped_quantiles(clean, [], "_v", {"median": 0.5})
    m = F.col("median")
    verdict = (F.when(m.isNull(), "unknown").when((m > 150) & (m < 350), "fail")
               .when((m > 40) & (m <= 150), "fail").otherwise("pass"))
    return median.select(F.inline(F.array(_finding("temperature_units", verdict, m))))


def summarise(findings: DataFrame) -> DataFrame:
    """Counts by severity and the overall verdict."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}")
                          for s in ("pass", "warn", "fail", "unknown")]).withColumn("passed", F.col("n_fail") == 0)


def conflict_dedup(df: DataFrame, keys: Sequence[str], value: str, tolerance: float, order: Sequence[str]) -> DataFrame:
    """Drop keys whose reports disagree by more than ``tolerance``; of the rest keep the first in ``order``.

    One aggregate yields both the range and the chosen row, so repeats combine on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    grouped = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_range"),
                                    F.min(F.struct(*lead, *rest)).alias("_row"))
    return grouped.where(F.col("_range") <= tolerance).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def post_write_audit(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: Sequence[int], year: int) -> DataFrame:
    """Row, duplicate, hour, year and missing-value counts of a written table."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value).isNull()).alias("_missing"),
        F.count_if(~F.hour(time).isin(*hours)).alias("_hours"), F.count_if(F.year(time) != year).alias("_years"),
        F.min(time).alias("_first"), F.max(time).alias("_last"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
        F.sum("_missing").alias("missing_values"), F.sum("_hours").alias("rows_with_invalid_hour"),
        F.sum("_years").alias("rows_outside_year"), F.min("_first").alias("first_time"), F.max("_last").alias("last_time"))
