"""Least-squares fits from sums, leave-one-out included."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import attach_row


def guarded_slope(y: str, x: str) -> Column:
    """Aggregate: slope of y on x; NULL with fewer than two points or no spread in x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px = F.when(both, F.col(x))
    enough = (F.count(px) >= 2) & (F.max(px) > F.min(px))
    return F.when(enough, F.regr_slope(F.when(both, F.col(y)), px))


def leave_one_out_slopes(points: DataFrame, by: Sequence[str], unit: str, x: str, y: str,
                         informative: int = 4) -> DataFrame:
    """Slope without each unit in turn, from group sums minus the unit's own terms.

    With fewer than ``informative`` units the remaining fit says nothing about
    stability, so ``informative`` is false there.
    """
    def per_group(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(table, list(by)) if by else attach_row(df, table)

    usable = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # Centred terms keep the differences of sums accurate.
    centre = usable.groupBy(*by).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    shifted = (per_group(usable, centre).withColumn("_x", F.col(x) - F.col("_cx")).withColumn("_y", F.col(y) - F.col("_cy")))
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"),
             "xy": F.col("_x") * F.col("_y")}
    per_unit = shifted.groupBy(*by, unit).agg(*[F.sum(e).alias(k) for k, e in terms.items()])
    total = per_unit.groupBy(*by).agg(*[F.sum(k).alias(f"t_{k}") for k in terms],
                                            F.count(F.lit(1)).alias("n_units"))
    rest = {k: F.col(f"t_{k}") - F.col(k) for k in terms}
    spread = rest["xx"] - rest["x"] * rest["x"] / rest["n"]
    slope = F.when((rest["n"] >= 2) & (spread > 1e-12 * F.col("t_xx")),
                   (rest["xy"] - rest["x"] * rest["y"] / rest["n"]) / spread)
    return per_group(per_unit, total).select(
        *by, F.col(unit).alias("excluded"), (F.col("n_units") - 1).alias("n_remaining"), slope.alias("slope"),
        (F.col("n_units") >= informative).alias("informative"))


def standardised_regression(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Standardised coefficients and R-squared of y on several covariates.

    Spark reduces each group to its correlation matrix; only that matrix, whose
    size depends on the number of covariates, is solved per row.
    """
    xs, by = list(xs), list(by)
    names = [*xs, y]
    rows = df.na.drop(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    table = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.array(*[F.corr(a, b) for a, b in pairs]).alias("_r"))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), "covariate string", "standardised_beta double",
                        "r_squared double", "n_rows bigint"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                matrix = np.eye(len(names))
                for (a, b), r in zip(pairs, record["_r"]):
                    i, j = names.index(a), names.index(b)
                    matrix[i, j] = matrix[j, i] = np.nan if r is None else r
                inner, cross = matrix[:-1, :-1], matrix[:-1, -1]
                beta = (np.linalg.lstsq(inner, cross, rcond=None)[0] if np.isfinite(matrix).all()
                        else np.full(len(xs), np.nan))
                for name, value in zip(xs, beta):
                    out.append({**{k: record[k] for k in by}, "covariate": name, "standardised_beta": float(value),
                                "r_squared": float(beta @ cross), "n_rows": int(record["n_rows"])})
            yield pd.DataFrame(out, columns=[*by, "covariate", "standardised_beta", "r_squared", "n_rows"])

    return table.mapInPandas(solve, schema)


def reduce_families(models: DataFrame, cohort: str, family: str, model: str, values: Sequence[str]) -> DataFrame:
    """Centre inside each cohort of at least two models, then average duplicate families."""
    stats = models.groupBy(cohort).agg(F.count_distinct(model).alias("_n"),
                                       *[F.avg(v).alias(f"_m_{v}") for v in values])
    centred = models.join(stats.where(F.col("_n") >= 2), cohort)
    return centred.groupBy(family).agg(*[F.avg(F.col(v) - F.col(f"_m_{v}")).alias(v) for v in values])
