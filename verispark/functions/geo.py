"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
DEGREE_KM = 2 * math.pi * EARTH_RADIUS_KM / 360


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, cos_a: Column | None = None, cos_b: Column | None = None) -> Column:
    """Great-circle distance in kilometres between two points given in degrees; a join may bring the cosines of their latitudes along."""
    cos_a, cos_b = F.cos(F.radians(lat_a)) if cos_a is None else cos_a, F.cos(F.radians(lat_b)) if cos_b is None else cos_b
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    inner = half_lat * half_lat + cos_a * cos_b * half_lon * half_lon
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(bounded))


def unit_xyz(latitude: Column, longitude: Column) -> tuple[Column, Column, Column]:
    """Cartesian coordinates on the unit sphere."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord_of_arc(distance_km: float) -> float:
    """Unit-sphere chord spanned by a great-circle distance."""
    angle = min(distance_km / EARTH_RADIUS_KM, math.pi)
    return 2 * math.sin(angle / 2)


def arc_of_chord_km(chord: Column) -> Column:
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), chord / 2))


def wrap_longitude(longitude: Column) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(longitude + 180.0, F.lit(360.0)) - 180.0


def degree_block(latitude: Column, longitude: Column, degrees: float) -> Column:
    """``row_column`` label of a fixed latitude-longitude block."""
    return F.concat_ws("_", F.floor(latitude / degrees).cast("string"), F.floor(longitude / degrees).cast("string"))


def offset_block(latitude: Column, longitude: Column, degrees: float) -> Column:
    """Block label counted from the south pole and the dateline, longitude wrapped."""
    row = F.floor((latitude + 90.0) / degrees)
    column = F.floor(F.pmod(longitude + 180.0, F.lit(360.0)) / degrees)
    return F.concat_ws("_", row.cast("string"), column.cast("string"))


def padded(number: Column, digits: int) -> Column:
    """A whole number with leading zeros up to ``digits``; longer ones keep every digit."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


class EqualAreaBands:
    """Latitude bands of a target height, each cut into slices of near-equal area.

    The bands number pi*R/cell at most (a 10 km cell gives about 2000), so they
    are literals of the expression and assignment needs no join.
    """

    def __init__(self, cell_km: float):
        self.cell_km = float(cell_km)
        self.bands = max(round(180.0 / (self.cell_km / DEGREE_KM)), 2)
        height = 180.0 / self.bands
        self.edges = [-90.0 + height * i for i in range(self.bands)] + [90.0]
        sphere = 2 * math.pi * EARTH_RADIUS_KM ** 2
        band_areas = [sphere * (math.sin(math.radians(north)) - math.sin(math.radians(south)))
                      for south, north in zip(self.edges, self.edges[1:])]
        self.slices = [max(round(area / self.cell_km ** 2), 1) for area in band_areas]
        self.cell_areas_km2 = [area / n for area, n in zip(band_areas, self.slices)]

    def _pick(self, values: list, position: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)

    def band(self, latitude: Column) -> Column:
        height = 180.0 / self.bands
        return F.least(F.lit(self.bands - 1), F.greatest(F.lit(0), F.floor((latitude + 90.0) / height))).cast("int")

    def cell_id(self, latitude: Column, longitude: Column) -> Column:
        band = self.band(latitude)
        slices = self._pick(self.slices, band)
        # The fold is part of the definition: on the edge of a slice, its rounding decides.
        turn = (longitude % 360.0 + 360.0) % 360.0 / 360.0
        index = F.least(slices - 1, F.floor(turn * slices)).cast("int")
        return F.concat(F.lit("b"), padded(band, 3), F.lit("s"), padded(index, 4))

    def parse(self, cell_id: Column) -> tuple[Column, Column]:
        pattern = "^b([0-9]+)s([0-9]+)$"
        return F.regexp_extract(cell_id, pattern, 1).cast("int"), F.regexp_extract(cell_id, pattern, 2).cast("int")

    def centre(self, cell_id: Column) -> tuple[Column, Column]:
        """Latitude halving the cell's area and the middle longitude."""
        band, index = self.parse(cell_id)
        mid_lat = [math.degrees(math.asin((math.sin(math.radians(s)) + math.sin(math.radians(n))) / 2))
                   for s, n in zip(self.edges, self.edges[1:])]
        longitude = (index + 0.5) * 360.0 / self._pick(self.slices, band)
        return self._pick(mid_lat, band), wrap_longitude(longitude)

    def area_km2(self, cell_id: Column) -> Column:
        band, _ = self.parse(cell_id)
        return self._pick(self.cell_areas_km2, band)


def transverse_mercator(latitude: Column, longitude: Column, central_meridian: float | Column,
                        scale: float = 0.9996, false_easting: float = 500000.0) -> tuple[Column, Column]:
    """Easting and northing in metres on the GRS80 ellipsoid (third-order Krueger series)."""
    semi_major, flattening = 6378137.0, 1 / 298.257222101
    n = flattening / (2 - flattening)
    rectifying = semi_major / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(latitude))
    conformal = F.sinh(F.atanh(sin_lat) - ecc * F.atanh(ecc * sin_lat))
    delta = F.radians(longitude - central_meridian)
    xi = F.atan2(conformal, F.cos(delta))
    eta = F.atanh(F.sin(delta) / F.sqrt(1 + conformal * conformal))
    east, north = eta, xi
    for k, coefficient in enumerate(alpha, start=1):
        east = east + coefficient * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + coefficient * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return false_easting + scale * rectifying * east, scale * rectifying * north


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((px - ax) * dx + (py - ay) * dy) / length2).otherwise(F.lit(0.0))
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(px - (ax + along * dx), py - (ay + along * dy))


def local_solar_hour(utc_hour: float, longitude: Column) -> Column:
    return F.pmod(F.lit(float(utc_hour)) + longitude / 15.0, F.lit(24.0))
