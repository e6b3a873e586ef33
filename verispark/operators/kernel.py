"""Gaussian kernels on the sphere, gridded interpolation and planar smoothing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import radius_pairs


def regular_axis(start: float, step: float, size: int) -> list[float]:
    return [start + step * i for i in range(size)]


def kernel_weights(targets: DataFrame, grid: DataFrame, sigmas_km: Sequence[float], truncation: float = 4.0,
                   target_id: str = "target_id", source_id: str = "source_id") -> DataFrame:
    """Row-normalised weights (target, sigma, source): Gaussian in distance times cos(latitude) area.

    ``grid`` has ``source_id, latitude, longitude``.  One distance join serves every sigma.  The job fails at a target
    without any source in reach: it would be missing from every later field.
    """
    pairs = radius_pairs(targets, grid, max(sigmas_km) * truncation, target_id, source_id,
                         keep_right=("latitude",))
    sigma = F.explode(F.array(*[F.lit(float(s)) for s in sigmas_km]))
    spread = pairs.withColumn("sigma_km", sigma).where(F.col("distance_km") <= F.col("sigma_km") * truncation)
    area = F.greatest(F.cos(F.radians("r_latitude")), F.lit(0.0))
    raw = F.exp(-0.5 * F.pow(F.col("distance_km") / F.col("sigma_km"), 2)) * area
    weighted = spread.select(F.col("l_id").alias(target_id), "sigma_km", F.col("r_id").alias(source_id),
                             raw.alias("_w"))
    # A target's row is its kernel footprint: bounded by the grid, whatever the data volume.
    row = Window.partitionBy(target_id, "sigma_km")
    shares = weighted.withColumn("weight", F.col("_w") / F.sum("_w").over(row)).drop("_w")
    wanted = targets.select(target_id, sigma.alias("sigma_km"))
    lonely = F.raise_error(F.concat(F.lit("no source within reach of target "), F.col(target_id).cast("string"), F.lit(" at "), F.col("sigma_km"), F.lit(" km")))
    found = F.when(F.col(source_id).isNull(), lonely.cast(dict(grid.dtypes)[source_id])).otherwise(F.col(source_id))
    return wanted.join(shares, [target_id, "sigma_km"], "left").withColumn(source_id, found)


def kernel_diagnostics(weights: DataFrame, truncation: float = 4.0, target_id: str = "target_id") -> DataFrame:
    """Footprint sizes, worst row-sum error and the bound on the radial mass left out."""
    rows = weights.groupBy("sigma_km", target_id).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("s"))
    return rows.groupBy("sigma_km").agg(
        F.count(F.lit(1)).alias("targets"), F.sum("n").alias("nonzero_weights"), F.min("n").alias("min_neighbours"),
        F.percentile("n", F.lit(0.5)).alias("median_neighbours"), F.max("n").alias("max_neighbours"),
        F.max(F.abs(F.col("s") - 1)).alias("max_row_sum_error"),
        F.lit(math.exp(-0.5 * truncation ** 2)).alias("omitted_mass_bound"))


def apply_kernel(weights: DataFrame, field: DataFrame, keys: Sequence[str], value: str, missing_aware: bool = False,
                 target_id: str = "target_id", source_id: str = "source_id", name: str = "smoothed") -> DataFrame:
    """Weighted sum of a long field (keys, source_id, value) at every (target, sigma).

    With ``missing_aware`` the weights of absent values are left out of the norm.
    """
    joined = field.join(weights, source_id).where(F.col(value).isNotNull())
    total = F.sum(F.col("weight") * F.col(value))
    result = F.try_divide(total, F.sum("weight")) if missing_aware else total
    return joined.groupBy(*keys, target_id, "sigma_km").agg(result.alias(name))


def bilinear(field: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, lat0: float, dlat: float,
             n_lat: int, lon0: float, dlon: float, n_lon: int, target_id: str = "target_id",
             name: str = "interpolated") -> DataFrame:
    """Bilinear values of a long field (keys, lat_idx, lon_idx, value) on a regular ascending grid.

    Each target names its four corners arithmetically and joins them.  There is
    no periodic wrap: a target past the last column is extrapolated.
    """
    lon = F.pmod(F.col("longitude"), F.lit(360.0))
    # A target exactly on a node belongs to the interval that ends there.
    row = F.least(F.lit(n_lat - 2), F.greatest(F.lit(0), F.ceil((F.col("latitude") - lat0) / dlat) - 1)).cast("int")
    column = F.least(F.lit(n_lon - 2), F.greatest(F.lit(0), F.ceil((lon - lon0) / dlon) - 1)).cast("int")
    placed = targets.select(target_id, row.alias("_i"), column.alias("_j"),
                            ((F.col("latitude") - lat0) / dlat).alias("_y"), ((lon - lon0) / dlon).alias("_x"))
    fy, fx = F.col("_y") - F.col("_i"), F.col("_x") - F.col("_j")
    corners = F.array(*[F.struct((F.col("_i") + di).alias("lat_idx"), (F.col("_j") + dj).alias("lon_idx"),
                                 ((fy if di else 1 - fy) * (fx if dj else 1 - fx)).alias("_w"))
                        for di in (0, 1) for dj in (0, 1)])
    spread = placed.select(target_id, F.inline(corners))
    return (field.join(spread, ["lat_idx", "lon_idx"]).groupBy(*keys, target_id)
            .agg(F.sum(F.col("_w") * F.col(value)).alias(name)))


def nearest_index(coordinate: Column, axis: Sequence[float], circular: bool = False) -> Column:
    """Index of the closest axis entry; a tie goes to the higher coordinate.

    The axis of a grid is a short literal list, so no join is needed.
    """
    entries = []
    for i, a in enumerate(axis):
        if circular:
            gap = F.abs(F.pmod(F.lit(float(a)) - F.pmod(coordinate, F.lit(360.0)) + 180.0, F.lit(360.0)) - 180.0)
            height = float(a) % 360
        else:
            gap, height = F.abs(F.lit(float(a)) - coordinate), float(a)
        entries.append(F.struct(F.round(gap, 9).alias("d"), F.lit(-height).alias("h"), F.lit(i).alias("i")))
    return F.array_min(F.array(*entries))["i"]


def ascending_grid(field: DataFrame, n_lat: int, n_lon: int, latitude_descends: bool = False,
                   longitude_descends: bool = False, transposed: bool = False) -> DataFrame:
    """Bring a long field to (latitude, longitude) order with both axes ascending."""
    first, second = ("lon_idx", "lat_idx") if transposed else ("lat_idx", "lon_idx")
    lat, lon = F.col(first), F.col(second)
    return (field.withColumn("_lat", (n_lat - 1 - lat) if latitude_descends else lat)
            .withColumn("_lon", (n_lon - 1 - lon) if longitude_descends else lon)
            .drop("lat_idx", "lon_idx").withColumnsRenamed({"_lat": "lat_idx", "_lon": "lon_idx"}))


def smoothing_matrix(size: int, sigma_cells: float, truncate: float = 4.0) -> np.ndarray:
    """One axis of a Gaussian filter whose border repeats the edge value."""
    reach = int(truncate * sigma_cells + 0.5)
    offsets = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (offsets / sigma_cells) ** 2) if sigma_cells > 0 else np.ones(1)
    weights = weights / weights.sum()
    matrix = np.zeros((size, size))
    for row in range(size):
        np.add.at(matrix[row], np.clip(row + offsets, 0, size - 1), weights)
    return matrix


def planar_smooth(fields: DataFrame, value: str, n_lat: int, n_lon: int, sigmas_km: Sequence[float],
                  cell_km_lat: float, cell_km_lon: float, keep: Sequence[str]) -> DataFrame:
    """Separable Gaussian filter of every patch, isotropic in kilometres.

    ``value`` holds one patch per row, row-major.  Patches are independent, so
    batches are filtered where they lie, without a shuffle.  Output: one row per
    (patch, sigma) with array columns ``raw`` and ``smoothed``.
    """
    filters = [(float(s), smoothing_matrix(n_lat, s / cell_km_lat), smoothing_matrix(n_lon, s / cell_km_lon))
               for s in sigmas_km]
    types = dict(fields.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "sigma_km double", "raw array<double>",
                        "smoothed array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            cube = np.stack([np.asarray(v, dtype=float) for v in batch[value]]).reshape(-1, n_lat, n_lon)
            for sigma, by_lat, by_lon in filters:
                smooth = np.einsum("ij,bjk,lk->bil", by_lat, cube, by_lon)
                out = batch[list(keep)].copy()
                out["sigma_km"] = sigma
                out["raw"] = list(cube.reshape(len(cube), -1))
                out["smoothed"] = list(smooth.reshape(len(cube), -1))
                yield out

    return fields.select(*keep, value).mapInPandas(run, schema)


def patch_structure(smoothed: DataFrame, keys: Sequence[str], n_lat: int, n_lon: int, margin: int) -> DataFrame:
    """Standard deviation of the residual and of the raw patch inside its core."""
    core = [i * n_lon + j for i in range(margin, n_lat - margin) for j in range(margin, n_lon - margin)]
    inside = F.array(*[F.struct(F.get("raw", F.lit(p)).alias("r"), F.get("smoothed", F.lit(p)).alias("s"))
                       for p in core])
    cells = smoothed.select(*keys, "sigma_km", F.inline(inside))
    return cells.groupBy(*keys, "sigma_km").agg(
        F.stddev_pop(F.col("r") - F.col("s")).alias("roughness"), F.stddev_pop("r").alias("domain_sd"))


def mean_gradient(fields: DataFrame, value: str, keys: Sequence[str], n_lat: int, n_lon: int, margin: int,
                  cell_km_lat: float, cell_km_lon: float) -> DataFrame:
    """Mean absolute gradient per 100 km of the core, both directions averaged."""
    core = [(i, j) for i in range(margin, n_lat - margin) for j in range(margin, n_lon - margin)]

    def at(i: int, j: int) -> Column:
        return F.get(value, F.lit(i * n_lon + j))

    ns = [F.abs(at(i + 1, j) - at(i, j)) for i, j in core if i + 1 < n_lat]
    ew = [F.abs(at(i, j + 1) - at(i, j)) for i, j in core if j + 1 < n_lon]
    ns_mean = F.aggregate(F.array(*ns), F.lit(0.0), lambda a, v: a + v) / len(ns) / cell_km_lat * 100
    ew_mean = F.aggregate(F.array(*ew), F.lit(0.0), lambda a, v: a + v) / len(ew) / cell_km_lon * 100
    return fields.select(*keys, ((ns_mean + ew_mean) / 2).alias("mean_gradient_per_100km"))


def circular_support(fields: DataFrame, value: str, keep: Sequence[str], half_widths: Sequence[int],
                     weightings: Sequence[str] = ("uniform", "gaussian")) -> DataFrame:
    """Average of each periodic field over a circular window of every half width.

    One row per (field, weighting, half width) with ``target`` as an array; the
    averages are products of spectra, field by field, without a shuffle.
    """
    types = dict(fields.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "weighting string", "half_width int",
                        "field array<double>", "target array<double>"])

    def kernel(grid: int, half: int, weighting: str) -> np.ndarray:
        offsets = np.arange(-half, half + 1)
        shape = np.exp(-0.5 * (offsets / max(half / 2, 1e-9)) ** 2) if weighting == "gaussian" and half else \
            np.ones(len(offsets))
        out = np.zeros(grid)
        np.add.at(out, offsets % grid, shape / shape.sum())
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            cube = np.stack([np.asarray(v, dtype=float) for v in batch[value]])
            grid = cube.shape[1]
            spectrum = np.fft.rfft(cube, axis=1)
            for weighting in weightings:
                for half in half_widths:
                    target = np.fft.irfft(spectrum * np.fft.rfft(kernel(grid, half, weighting)), n=grid, axis=1)
                    out = batch[list(keep)].copy()
                    out["weighting"], out["half_width"] = weighting, np.int32(half)
                    out["field"], out["target"] = list(cube), list(target)
                    yield out

    return fields.select(*keep, value).mapInPandas(run, schema)
