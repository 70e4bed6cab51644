"""Spherical geometry as column expressions. Degrees for places, metres for lengths, radians for bearings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius in metres; latitude from which a bearing is undefined; least cosine in a division.
RADIUS_M = 6_371_000.0
POLE_LAT = 89.99
LEAST_COS = 1e-9
METRES_PER_DEGREE = math.pi * RADIUS_M / 180.0


def wrap_lon(lon: Column) -> Column:
    """A longitude in (-180, 180]."""
    turned = F.pmod(lon + 540.0, F.lit(360.0)) - 180.0
    return F.when(turned == -180.0, F.lit(180.0)).otherwise(turned)


def lon_delta(a: Column, b: Column) -> Column:
    """The short way from longitude a to b, in (-180, 180]."""
    return wrap_lon(b - a)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    up = F.sin(F.radians(lat2 - lat1) / 2)
    across = F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))) * (2 * RADIUS_M)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial compass bearing in radians (north 0, east positive); null at a pole."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when(F.abs(lat1) < POLE_LAT, angle)


def destination(lon: Column, lat: Column, metres: Column, angle: Column) -> tuple[Column, Column]:
    """(lon, lat) reached from a place; null where it starts at a pole."""
    c, a = metres / RADIUS_M, F.radians(lat)
    up = F.sin(a) * F.cos(c) + F.cos(a) * F.sin(c) * F.cos(angle)
    b = F.asin(F.least(F.greatest(up, F.lit(-1.0)), F.lit(1.0)))
    d = F.atan2(F.sin(angle) * F.sin(c) * F.cos(a), F.cos(c) - F.sin(a) * F.sin(b))
    fine = F.abs(lat) < POLE_LAT
    return F.when(fine, wrap_lon(lon + F.degrees(d))), F.when(fine, F.degrees(b))


def delta_to_tangent(lat: Column, dlon: Column, dlat: Column) -> tuple[Column, Column]:
    """Degrees from a place as (east, north) metres in its tangent plane."""
    return dlon * METRES_PER_DEGREE * F.cos(F.radians(lat)), dlat * METRES_PER_DEGREE


def tangent_to_delta(lat: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """(east, north) metres as degrees; the cosine has a floor near the poles."""
    return east / (F.greatest(F.cos(F.radians(lat)), F.lit(LEAST_COS)) * METRES_PER_DEGREE), north / METRES_PER_DEGREE


def offset(lon: Column, lat: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """A place moved by tangent metres, its latitude kept off the poles."""
    dlon, dlat = tangent_to_delta(lat, east, north)
    return wrap_lon(lon + dlon), F.least(F.greatest(lat + dlat, F.lit(-POLE_LAT)), F.lit(POLE_LAT))


def between(lon1: Column, lat1: Column, lon2: Column, lat2: Column, f: Column) -> tuple[Column, Column]:
    """The place a fraction of the way, straight in degrees and the short way round."""
    return wrap_lon(lon1 + lon_delta(lon1, lon2) * f), lat1 + (lat2 - lat1) * f


def line_latitude(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon: Column) -> Column:
    """Latitude of the line between two places at a longitude; their mean where the line runs north-south."""
    span = lon_delta(lon1, lon2)
    flat = F.abs(span) < 1e-12
    part = lon_delta(lon1, lon) / F.when(flat, F.lit(1.0)).otherwise(span)
    return F.when(flat, (lat1 + lat2) / 2).otherwise(lat1 + (lat2 - lat1) * F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 540.0, F.lit(360.0)) - 180.0)


class Box:
    """A longitude-latitude box; lon_min > lon_max runs across the antimeridian."""

    def __init__(self, lon_min: float, lon_max: float, lat_min: float, lat_max: float):
        self.lon_min, self.lon_max, self.lat_min, self.lat_max = lon_min, lon_max, lat_min, lat_max

    @property
    def wraps(self) -> bool:
        return self.lon_min > self.lon_max

    @property
    def lon_extent(self) -> float:
        return self.lon_max - self.lon_min + (360.0 if self.wraps else 0.0)

    @property
    def lat_extent(self) -> float:
        return self.lat_max - self.lat_min

    def usable(self) -> bool:
        return self.lat_max > self.lat_min and self.lon_min != self.lon_max

    def diagonal_m(self) -> float:
        a, b = math.radians(self.lat_min), math.radians(self.lat_max)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(self.lon_max - self.lon_min) / 2) ** 2
        return 2 * RADIUS_M * math.asin(math.sqrt(min(1.0, h)))

    def holds_lon(self, lon: Column) -> Column:
        inside = [lon >= self.lon_min, lon <= self.lon_max]
        return inside[0] | inside[1] if self.wraps else inside[0] & inside[1]

    def holds(self, lon: Column, lat: Column) -> Column:
        return self.holds_lon(lon) & lat.between(self.lat_min, self.lat_max)

    def clamp(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """The nearest place in the box; across the antimeridian a longitude outside goes to the nearer edge."""
        if self.wraps:
            to_min, to_max = F.abs(lon_delta(lon, F.lit(self.lon_min))), F.abs(lon_delta(lon, F.lit(self.lon_max)))
            kept = F.when(self.holds_lon(lon), lon).when(to_min <= to_max, F.lit(self.lon_min)).otherwise(F.lit(self.lon_max))
        else:
            kept = F.least(F.greatest(lon, F.lit(self.lon_min)), F.lit(self.lon_max))
        low, high = max(self.lat_min, -POLE_LAT), min(self.lat_max, POLE_LAT)
        return kept, F.least(F.greatest(lat, F.lit(low)), F.lit(high))

    def clamped_to(self, sub: "Box | None") -> "Box":
        """The part of this box within another. Where either wraps, the other's longitudes are taken as they are;
        the result can be empty, see usable()."""
        if sub is None:
            return self
        south, north = max(self.lat_min, sub.lat_min), min(self.lat_max, sub.lat_max)
        if self.wraps or sub.wraps:
            return Box(sub.lon_min, sub.lon_max, south, north)
        return Box(max(self.lon_min, sub.lon_min), min(self.lon_max, sub.lon_max), south, north)
