"""Verification panels: long form, complete cases, common cases, one series per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .contracts import first_per_key


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed value is present (NaN counts as missing)."""
    return df.na.drop(subset=list(columns))


def to_long(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per listed column; NULL values are kept."""
    keep = [c for c in df.columns if c not in columns]
    return df.unpivot([F.col(f"`{c}`") for c in keep], [F.col(f"`{c}`") for c in columns], name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], measure: str) -> DataFrame:
    """Pivot with a declared list of columns, so no extra pass discovers them."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.avg(measure))


def error_columns(models: Sequence[str], references: Sequence[str], kind: str = "absolute") -> list[Column]:
    """``reference__model`` error of every combination."""
    shapes = {"absolute": F.abs, "squared": lambda e: e * e, "signed": lambda e: e}
    return [shapes[kind](F.col(f"`{m}`") - F.col(f"`{r}`")).alias(f"{r}__{m}") for r in references for m in models]


def case_keys(df: DataFrame, keys: Sequence[str], member: str, n_members: int | Column) -> DataFrame:
    """Keys for which all ``n_members`` distinct members are present (relational division)."""
    found = df.groupBy(*keys).agg(F.count_distinct(member).alias("_n"))
    return found.where(F.col("_n") == n_members).select(*keys)


def common_cases(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keep the keys that every member covers, so all are scored on identical cases.

    The input is written once: its members are counted, its keys divided and its rows kept from that table.
    """
    df = cut_lineage(df)
    total = df.select(F.count_distinct(member).alias("n")).head().n
    return df.join(case_keys(df, keys, member, total), list(keys), "left_semi")


def common_support(df: DataFrame, keys: Sequence[str], columns: Sequence[str], member: str,
                   n_members: int | None = None) -> DataFrame:
    """Keys at which every member has every column; without ``n_members`` the members of the input are counted."""
    if n_members is None:
        df = cut_lineage(df)
        n_members = df.select(F.count_distinct(member).alias("n")).head().n
    filled = complete_cases(df, columns)
    return filled.join(case_keys(filled, keys, member, n_members), list(keys), "left_semi")


def collapse_sites(panel: DataFrame, membership: DataFrame, extra_keys: Sequence[str] = ("model", "valid_time"),
                   priority: Sequence[str] = ("network_rank", "station_id")) -> DataFrame:
    """One row per (site, extra keys): the best-ranked member that reported.

    ``membership`` has ``station_id, site_id, network_rank``.
    """
    joined = panel.join(membership, "station_id")
    return first_per_key(joined, ["site_id", *extra_keys], list(priority)).drop("network_rank")


def with_valid_time(df: DataFrame, init: str = "init_time", lead: str = "lead_h") -> DataFrame:
    return df.withColumn("valid_time", F.col(init) + F.make_dt_interval(hours=F.col(lead).cast("int")))


def shared_times(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """Times available in every source."""
    shared = frames[0].select(column)
    for frame in frames[1:]:
        shared = shared.intersect(frame.select(column))
    return shared.distinct()
