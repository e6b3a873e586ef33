"""Data contracts: required columns, join cardinality, deterministic deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The data break a stated contract."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def exact_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    extra = [name for name in df.columns if name not in set(names)]
    if extra:
        raise ContractError(f"unexpected columns: {extra}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"rows are not unique on {list(keys)}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str,
                 how: str = "inner") -> DataFrame:
    """Equi-join whose cardinality is asserted beforehand.

    ``one_to_one`` checks both sides, ``many_to_one`` the right, ``one_to_many``
    the left.  Each check is one pre-aggregated pass over the keys.
    """
    checks = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}
    if cardinality not in checks:
        raise ValueError(f"unknown cardinality {cardinality!r}")
    for side in checks[cardinality]:
        assert_unique(side.select(*keys), keys)
    return left.join(right, list(keys), how)


def guarded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """many-to-one join that fails inside the job if the right key repeats.

    The check rides on an aggregate of the right side that the join needs to
    shuffle anyway, so no extra action runs.
    """
    payload = [c for c in right.columns if c not in keys]
    unique = (right.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*payload)).alias("_row"))
              .withColumn("_row", F.when(F.col("_n") == 1, F.col("_row"))
                          .otherwise(F.raise_error(F.lit("join key repeats on the 'one' side"))))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload]))
    return left.join(unique, list(keys), how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame, such as totals, to every row."""
    tagged = F.broadcast(row.withColumn("_one", F.lit(0)))
    return df.withColumn("_one", F.lit(0)).join(tagged, "_one").drop("_one")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in ``order``.

    A struct minimum combines on the map side, so a key that owns a third of all
    rows still sends one row per task.  It sorts its rows, so each column is in them once.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in order if c in rest]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*ordered, *[c for c in rest if c not in ordered]]])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_present(column: str, order: Column) -> Column:
    """Aggregate: the first non-missing value of ``column`` under ``order``."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only; an empty result means the sets are equal."""
    sides = (left.select(*keys).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
             .unionByName(right.select(*keys).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))))
    return (sides.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
            .where(F.col("_l") != F.col("_r"))
            .select(*keys, F.when(F.col("_l") == 1, "left").otherwise("right").alias("only_in")))


def varying_within(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column that should be constant is not."""
    return (df.groupBy(*keys).agg(F.count_distinct(column).alias("n_values"))
            .where(F.col("n_values") > 1))
