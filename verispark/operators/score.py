"""Scores with explicit weighting: cases, days, or site-day inside cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import grouped_quantiles


def daily_components(long: DataFrame, by: Sequence[str], day: str, forecast: str, reference: str) -> DataFrame:
    """Per group and day: mean absolute, squared and signed error, with the case count."""
    error = F.col(forecast) - F.col(reference)
    return long.groupBy(*by, day).agg(
        F.avg(F.abs(error)).alias("absolute"), F.avg(error * error).alias("squared"),
        F.avg(error).alias("signed"), F.count(error).alias("n_cases"))


def day_weighted(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over days of the daily components, with the three derived RMSE flavours kept apart."""
    mse, bias = F.avg("squared"), F.avg("signed")
    centred = F.greatest(mse - bias * bias, F.lit(0.0))
    cases = F.sum("n_cases")
    return daily.groupBy(*by).agg(
        cases.alias("n_cases"), F.count(F.lit(1)).alias("n_days"),
        F.avg("absolute").alias("mae"), mse.alias("mse"), bias.alias("bias"),
        F.sqrt(mse).alias("rmse_day_weighted"), F.avg(F.sqrt("squared")).alias("rmse_daily_mean"),
        F.sqrt(F.sum(F.col("squared") * F.col("n_cases")) / cases).alias("rmse_cases"),
        (F.sum(F.col("absolute") * F.col("n_cases")) / cases).alias("mae_case_weighted"),
        (bias * bias).alias("bias_squared"), centred.alias("centred_mse"),
        F.sqrt(centred).alias("centred_rmse"))


def daily_median_error(long: DataFrame, by: Sequence[str], day: str, forecast: str, reference: str) -> DataFrame:
    """Median absolute error of each day."""
    errors = long.select(*by, day, F.abs(F.col(forecast) - F.col(reference)).alias("_e"))
    return grouped_quantiles(errors, [*by, day], "_e", {"medae": 0.5})


def hierarchical_mean(df: DataFrame, levels: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Means of means: average at the first key set, then at each shorter one.

    Levels only drop keys, so after the first shuffle the data shrink to one row
    per finest key.
    """
    current = df
    for keys in levels:
        current = current.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values],
                                             F.count(F.lit(1)).alias("n_units"))
    return current


def min_rank(by: Sequence[str], score: str) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(score)).cast("bigint")


def winner(name: str, score: str, tie: str | None = None) -> Column:
    """Aggregate: the name with the smallest score, ties to the smallest ``tie``."""
    return F.min_by(F.col(name), F.struct(F.col(score), F.col(tie or name)))


def ordering(name: str, score: str, tie: str | None = None, separator: str = "|") -> Column:
    """Aggregate: names from best to worst as one string; the group is a handful of models."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(score), F.col(tie or name).alias("_tie"),
                                                   F.col(name).alias("_name"))))
    return F.array_join(F.transform(ordered, lambda r: r["_name"]), separator)
