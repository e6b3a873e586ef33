"""Choosing stations and partitioning them into regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean over their population spread; a constant column becomes zero."""
    stats = df.agg(*[f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).head()
    return df.withColumns({f"z_{c}": (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in columns})


def farthest_points(candidates: DataFrame, station_id: str, columns: Sequence[str], coverage: str, k: int) -> DataFrame:
    """Greedy selection of ``k`` stations that spread over the standardised columns.

    Starts from the best covered station; each step takes the station farthest
    from those chosen, ties to the smallest id.  A step is one distributed
    maximum, and only the chosen row reaches the driver.
    """
    scaled = standardised(candidates.select(station_id, coverage, *columns), columns)
    z = [f"z_{c}" for c in columns]
    open_set = cut_lineage(scaled.select(station_id, coverage, *z))
    seed = open_set.agg(F.min(F.struct((-F.col(coverage)).alias("c"), F.col(station_id).alias("id"),
                                       *[F.col(c) for c in z])).alias("r")).head().r
    chosen, gap = [seed], None
    while len(chosen) < k:
        latest = chosen[-1]
        step = F.sqrt(sum(((F.col(c) - latest[c]) * (F.col(c) - latest[c]) for c in z), F.lit(0.0)))
        gap = step if gap is None else F.least(gap, step)
        if len(chosen) % 16 == 0:
            # Keep the expression short: settle the distance to the chosen set so far.
            open_set = cut_lineage(open_set.withColumn("_gap", gap))
            gap = F.col("_gap")
        best = open_set.where(~F.col(station_id).isin([r["id"] for r in chosen])).agg(F.min(F.struct(
            (-F.round(gap, 9)).alias("g"), F.col(station_id).alias("id"), *[F.col(c) for c in z])).alias("r")).head().r
        if best is None:
            break
        chosen.append(best)
    order = [(i, r["id"]) for i, r in enumerate(chosen)]
    id_type = dict(candidates.dtypes)[station_id]
    return candidates.sparkSession.createDataFrame(order, f"pick int, {station_id} {id_type}")


def lloyd(points: DataFrame, columns: Sequence[str], seeds: Sequence[Sequence[float]], most: int = 300) -> list[tuple[float, ...]]:
    """Centres of k-means from given ones to the fixed point, by ascending number of the seed.

    A step assigns every point to its nearest centre, ties to the first, and sums the clusters on the map side; only as many
    rows as there are clusters reach the driver.  A cluster that loses all points keeps its centre.
    """
    centres = [tuple(float(v) for v in c) for c in seeds]
    for _ in range(most):
        sums = points.groupBy(nearest_centre(columns, centres).alias("c")).agg(*[F.round(F.avg(c), 9).alias(c) for c in columns])
        moved = {r.c: tuple(r[c] for c in columns) for r in sums.collect()}
        following = [moved.get(k, c) for k, c in enumerate(centres)]
        if following == centres:
            break
        centres = following
    return centres


def nearest_centre(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre, ties to the first."""
    def gap(centre: Sequence[float]) -> Column:
        return F.round(F.sqrt(sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(columns, centre, strict=True)), F.lit(0.0))), 9)
    return F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))["k"]


def kmeans_regions(stations: DataFrame, station_id: str, x: str, y: str, clusters: int, name: str = "region") -> DataFrame:
    """Regions by k-means on projected coordinates, from the stations that spread farthest, numbered from north to south.

    A station without coordinates has no region.
    """
    stations = cut_lineage(stations)
    points = stations.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    picks = farthest_points(points.withColumn("_even", F.lit(1)), station_id, (x, y), "_even", clusters)
    seeds = picks.join(points, station_id).orderBy("pick").select(x, y).collect()  # as many rows as clusters
    centres = sorted(lloyd(points, (x, y), [tuple(r) for r in seeds]), key=lambda c: (-c[1], c[0]))
    label = F.concat(F.lit("r"), F.lpad(nearest_centre((x, y), centres).cast("string"), 2, "0"))
    return stations.join(points.select(station_id, label.alias(name)), station_id, "left")
