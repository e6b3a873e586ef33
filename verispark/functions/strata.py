"""Stratum labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def climate_belt(latitude: Column) -> Column:
    size = F.abs(latitude)
    return (F.when(size < 23.5, "tropical").when(size < 45.0, "subtropical")
            .when(size < 66.5, "midlatitude").otherwise("polar"))


def latitude_belt(latitude: Column) -> Column:
    return (F.when(latitude < -23.5, "south_extratropics").when(latitude > 23.5, "north_extratropics")
            .otherwise("tropics"))


def coast_stratum(distance_km: Column, limit_km: float = 25.0) -> Column:
    return F.when(distance_km <= limit_km, "coast").otherwise("interior")


def altitude_stratum(altitude_m: Column, limits: tuple[float, float] = (300.0, 1000.0)) -> Column:
    low, high = limits
    return (F.when(altitude_m.isNull(), "unknown").when(altitude_m < low, "lowland").when(altitude_m < high, "upland")
            .otherwise("mountain"))


def density_stratum(stations_in_cell: Column) -> Column:
    return F.when(stations_in_cell >= 2, "shared_cell").otherwise("single_station_cell")


def by_edges(value: Column, edges: Column) -> Column:
    """1-based bin of ``value`` among inner ``edges``; bins are closed on the right."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e < value)) + 1).cast("int")
