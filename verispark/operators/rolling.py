"""Centred rolling median over report order, split by time so no series is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_of(values: Column) -> Column:
    """Median of a short array, NULL entries ignored."""
    ordered = F.array_sort(F.array_compact(values))
    size = F.size(ordered)
    middle = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    upper = F.get(ordered, F.floor(size / 2).cast("int"))
    return (middle + upper) / 2


def centred_median(df: DataFrame, key: str, order: Sequence[str], value: str, half: int = 2,
                   bucket: str = "day", median: str = "rolling_median", count: str = "rolling_count") -> DataFrame:
    """Median and count of the ``2*half+1`` neighbouring reports of each report.

    Rows are windowed per (series, time bucket).  The first and last ``half``
    rows of every bucket form a thin edge table; a window over the edges alone
    finds what lies beyond each boundary, and those rows are handed to the bucket
    as a halo.  One series may therefore hold any share of the data.
    ``order[0]`` must be a timestamp; every report counts, also those that share their times.
    """
    order = list(order)
    slim = (df.withColumn("_bucket", F.date_trunc(bucket, F.col(order[0])))
            .withColumn("_value", F.col(value)))
    cell = [key, "_bucket"]
    # Reports that share a time follow one another by value; equal ones are told apart by number.
    names = order
    tied = Window.partitionBy(*cell, *order, "_value").orderBy(F.lit(0))
    slim = slim.withColumn("_rank_value", F.col("_value")).withColumn("_tie", F.row_number().over(tied))
    order = [*order, "_rank_value", "_tie"]
    ascending = Window.partitionBy(*cell).orderBy(*order)
    descending = Window.partitionBy(*cell).orderBy(*[F.desc(c) for c in order])
    core = slim.select(key, "_bucket", *order, "_value")
    # Two rank filters instead of one window: each is cut to ``half`` rows per
    # bucket before its shuffle.
    head = core.withColumn("_n", F.row_number().over(ascending)).where(F.col("_n") <= half)
    tail = core.withColumn("_n", F.row_number().over(descending)).where(F.col("_n") <= half)
    head = head.select(key, "_bucket", *order, "_value", F.lit(True).alias("_head"), F.lit(False).alias("_tail"))
    tail = tail.select(key, "_bucket", *order, "_value", F.lit(False).alias("_head"), F.lit(True).alias("_tail"))
    edges = (head.unionByName(tail).groupBy(key, "_bucket", *order)
             .agg(F.first("_value").alias("_value"), F.max("_head").alias("_head"), F.max("_tail").alias("_tail")))
    series = Window.partitionBy(key).orderBy(*order)
    first_row = F.row_number().over(ascending) == 1
    last_row = F.row_number().over(descending) == 1
    around = edges.withColumn("_first", first_row).withColumn("_last", last_row)
    packed = F.struct(*order, "_value")
    for step in range(1, half + 1):
        around = (around.withColumn(f"_b{step}", F.lag(packed, step).over(series))
                  .withColumn(f"_f{step}", F.lead(packed, step).over(series)))
    before = F.when(F.col("_first"), F.array(*[F.col(f"_b{s}") for s in range(1, half + 1)]))
    after = F.when(F.col("_last"), F.array(*[F.col(f"_f{s}") for s in range(1, half + 1)]))
    halo = (around.where(F.col("_first") | F.col("_last"))
            .select(key, "_bucket", F.explode(F.array_compact(F.concat(
                F.coalesce(before, F.array().cast(_array_type(around, packed))),
                F.coalesce(after, F.array().cast(_array_type(around, packed)))))).alias("_r"))
            .select(key, "_bucket", *[F.col(f"_r.{c}").alias(c) for c in order],
                    F.col("_r._value").alias("_value"), F.lit(True).alias("_halo")))
    payload = [c for c in df.columns if c not in (key, *names)]
    main = slim.select(key, "_bucket", *order, "_value", F.lit(False).alias("_halo"),
                       F.struct(*payload).alias("_row") if payload else F.lit(None).alias("_row"))
    full = main.unionByName(halo, allowMissingColumns=True)
    near = [F.lag("_value", s).over(ascending) for s in range(half, 0, -1)]
    near += [F.col("_value")] + [F.lead("_value", s).over(ascending) for s in range(1, half + 1)]
    rolled = full.withColumn("_near", F.array(*near)).where(~F.col("_halo"))
    return rolled.select(
        key, *names, *[F.col(f"_row.`{c}`").alias(c) for c in payload],
        median_of(F.col("_near")).alias(median),
        F.size(F.array_compact(F.col("_near"))).cast("bigint").alias(count))


def _array_type(df: DataFrame, packed: Column) -> str:
    return f"array<{df.select(packed.alias('_s')).schema['_s'].dataType.simpleString()}>"


def local_median_flag(value: Column, median: Column, count: Column, minimum: int = 3,
                      deviation: float = 4.0) -> Column:
    """The report lies within ``deviation`` of the median of at least ``minimum`` reports."""
    return (count >= minimum) & (F.abs(value - median) <= deviation)


def rolling_quality(df: DataFrame, key: str, order: Sequence[str], value: str, usable: Column,
                    mode: str = "valid_rows", minimum: int = 3, deviation: float = 4.0,
                    bucket: str = "day") -> DataFrame:
    """Add ``rolling_median``, ``rolling_count`` and ``qc_valid``.

    ``valid_rows`` drops unusable reports before the window, so its five rows
    are five usable reports.  ``masked_rows`` blanks them but keeps their place.
    """
    flagged = df.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    if mode == "masked_rows":
        blanked = flagged.withColumn("_masked", F.when(F.col("_usable"), F.col(value)))
        rolled = centred_median(blanked, key, order, "_masked", bucket=bucket).drop("_masked")
    elif mode == "valid_rows":
        # Unusable reports need no window: they rejoin as they are.
        kept = centred_median(flagged.where("_usable"), key, order, value, bucket=bucket)
        rolled = kept.unionByName(flagged.where("NOT _usable"), allowMissingColumns=True)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    good = F.col("_usable") & local_median_flag(F.col(value), F.col("rolling_median"),
                                                F.col("rolling_count"), minimum, deviation)
    return rolled.withColumn("qc_valid", F.coalesce(good, F.lit(False))).drop("_usable")
