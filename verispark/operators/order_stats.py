"""Exact ranks and quantiles that never gather a group into one task.

Values are first counted per (group, value), which collapses ties on the map
side.  When every group is small enough for a task (its row count is checked,
not assumed) a plain window or percentile finishes the job.  Otherwise the
distinct values are cut into buckets at approximate quantiles; bucket totals give
each bucket's offset and a window inside one bucket gives the rest.  The split
points only steer the balance, never the result, but both branches of the plan
must see the same ones, so they are checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strata import by_edges
from ..session import cut_lineage
from .contracts import attach_row


TASK_ROWS = 1_000_000


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN read as missing in the named floating-point columns."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(types[c])) for c in columns if types[c] in ("double", "float")})


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation that leaves an order statistic as it is where nothing has to be interpolated, infinite ones too."""
    return F.when((share == 0) | (low == high), low).otherwise(low + share * (high - low))


def fits_a_task(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """Whether the largest group holds at most ``limit`` rows: one pre-aggregated count."""
    limit = TASK_ROWS if limit is None else limit
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head().n
    return (largest or 0) <= limit


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                      buckets: int = 64, limit: int | None = None) -> DataFrame:
    """Per distinct value: its count, the count below it and the group total."""
    by = list(by)
    df = without_nan(df, value)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.alias("n_equal"))
    if fits_a_task(df, by, limit):
        return (counts.withColumn("n_below", F.sum("n_equal").over(Window.partitionBy(*by).orderBy(value)) - F.col("n_equal"))
                .withColumn("n_total", F.sum("n_equal").over(Window.partitionBy(*by))))
    # Computed values may differ in their last bits when a branch is recomputed, and the
    # values are keys below: everything starts from one written table.
    counts = cut_lineage(counts)
    probes = [F.lit((i + 1) / buckets) for i in range(buckets - 1)]
    edges = counts.groupBy(*by).agg(F.array_distinct(
        F.percentile_approx(value, F.array(*probes), F.lit(1000))).alias("_edges"))
    edges = cut_lineage(edges)
    binned = counts.join(edges, by) if by else attach_row(counts, edges)
    binned = binned.withColumn("_bucket", by_edges(F.col(value), F.col("_edges"))).drop("_edges")
    totals = binned.groupBy(*by, "_bucket").agg(F.sum("n_equal").alias("_size"))
    order = Window.partitionBy(*by).orderBy("_bucket")
    totals = (totals.withColumn("_offset", F.sum("_size").over(order) - F.col("_size"))
              .withColumn("n_total", F.sum("_size").over(Window.partitionBy(*by)))
              .drop("_size"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    return (binned.join(totals, [*by, "_bucket"])
            .withColumn("n_below", F.col("_offset") + F.sum("n_equal").over(inside) - F.col("n_equal"))
            .select(*by, value, "n_equal", "n_below", "n_total"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str, limit: int | None = None) -> DataFrame:
    """Every row with the mean rank of its tie group, NULL where the value is missing."""
    df = cut_lineage(without_nan(df, value))
    ranks = (cumulative_counts(df, by, value, limit=limit)
             .select(*by, value, (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias(name)))
    return df.join(ranks, [*by, value], "left")


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                      limit: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles of every group, one column per entry of ``probs``."""
    df = without_nan(df, value)
    if fits_a_task(df, by, limit):
        group = Window.partitionBy(*by)
        place = (df.where(F.col(value).isNotNull()).select(*by, value)
                 .withColumn("_k", F.row_number().over(group.orderBy(value)) - 1)
                 .withColumn("_n", F.count(F.lit(1)).over(group)))
        picks, columns = [], []
        for name, p in probs.items():
            position = (F.col("_n") - 1) * F.lit(float(p))
            low, high = F.col("_k") == F.floor(position), F.col("_k") == F.ceil(position)
            picks.append(low | high)
            columns.append(interpolated(F.max(F.when(low, F.col(value))), F.max(F.when(high, F.col(value))),
                                        F.max(position - F.floor(position))).alias(name))
        wanted = picks[0]
        for pick in picks[1:]:
            wanted = wanted | pick
        return place.where(wanted).groupBy(*by).agg(F.max("_n").alias("n_values"), *columns)
    table = cumulative_counts(df, by, value, limit=0)
    low_high = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        for suffix, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_equal"))
            low_high.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{suffix}"))
    picked = table.groupBy(*by).agg(F.max("n_total").alias("n_values"), *low_high)
    columns = []
    for name, p in probs.items():
        position = (F.col("n_values") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append(interpolated(low, high, position - F.floor(position)).alias(name))
    return picked.select(*by, "n_values", *columns)


def quantile_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, name: str,
                  limit: int | None = None) -> DataFrame:
    """Equal-count bins with interpolated edges, closed on the right, repeated edges dropped.

    ``value`` is read twice: pass a stored column or a materialised frame, not an
    aggregate that a second run could round differently.
    """
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = grouped_quantiles(df, by, value, probs, limit)
    all_edges = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(bins + 1)]))
    inner = F.slice(all_edges, 2, F.greatest(F.size(all_edges) - 2, F.lit(0)))
    edges = edges.select(*by, inner.alias("_inner"))
    if by:
        joined = df.join(edges, list(by), "left")
    else:
        joined = attach_row(df, edges)
    return joined.withColumn(name, by_edges(F.col(value), F.col("_inner"))).drop("_inner")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "spearman",
             limit: int | None = None) -> DataFrame:
    """Rank correlation over rows where both values are present, average ranks for ties."""
    pairs = (without_nan(df, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_k")))
    if fits_a_task(df, by, limit):
        joined = ranked_within(ranked_within(pairs, by, x, "_rx", "_k"), by, y, "_ry", "_k")
    else:
        pairs = cut_lineage(pairs)
        joined = pairs
        for value, name_ in ((x, "_rx"), (y, "_ry")):
            ranks = cumulative_counts(pairs, by, value, weight="_k", limit=0).select(
                *by, value, (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias(name_))
            joined = joined.join(ranks, [*by, value])
    return joined.groupBy(*by).agg(
        weighted_correlation(F.col("_rx"), F.col("_ry"), F.col("_k")).alias(name),
        F.sum("_k").alias("n_pairs"))


def weighted_correlation(x: Column, y: Column, weight: Column) -> Column:
    """Aggregate: Pearson correlation with integer multiplicities; NULL without spread."""
    n = F.sum(weight)
    mean_x, mean_y = F.sum(weight * x) / n, F.sum(weight * y) / n
    cov = F.sum(weight * x * y) / n - mean_x * mean_y
    var_x = F.sum(weight * x * x) / n - mean_x * mean_x
    var_y = F.sum(weight * y * y) / n - mean_y * mean_y
    spread = F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0)))
    return F.when(spread > 1e-12, cov / spread)


def ranked_within(df: DataFrame, by: Sequence[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Average ranks by a plain window, for groups of bounded size such as the cells of one draw."""
    amount = F.col(weight) if weight else F.lit(1)
    upto = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy(*by, value)
    return df.withColumn(name, F.sum(amount).over(upto) - (F.sum(amount).over(tied) - 1) / 2)
