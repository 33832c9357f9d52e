"""Distances, projections and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres, kilometres and nautical miles.
EARTH_M, EARTH_KM, EARTH_NM = 6_371_000.0, 6371.0088, 3440.065


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of radius; null with any null coordinate."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(value: Column, width: float) -> Column:
    """Index of a grid cell of that width."""
    return F.floor(value / width)


def neighbours(lat: Column, lon: Column, width: float) -> Column:
    """The 3 x 3 cells around a point, as an array of (cy, cx)."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array(*(F.struct((cell(lat, width) + dy).alias("cy"), (cell(lon, width) + dx).alias("cx")) for dy, dx in around))


def around(lat: Column, lon: Column, width: float, metres: float) -> Column:
    """Cells that hold every place within so many metres of a point, as an array of (cy, cx).

    As many columns as the latitude asks for; columns count round the globe,
    as those of turned() do.
    """
    high = F.ceil(F.lit(metres / (width * math.pi * EARTH_M / 180)))
    narrow = F.greatest(F.cos(F.radians(F.least(F.abs(lat) + math.degrees(metres / EARTH_M), F.lit(90.0)))), F.lit(1e-3))
    wide = F.ceil(high / narrow)
    rows, columns = (F.sequence(cell(c, width) - k, cell(c, width) + k) for c, k in ((lat, high), (lon, wide)))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("cy"), F.pmod(x, F.lit(round(360 / width))).alias("cx")))))


def turned(lon: Column, width: float) -> Column:
    """Column of a longitude's cell, counted round the globe."""
    return F.pmod(cell(lon, width), F.lit(round(360 / width)))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing (m) in the zone of lon, by the Krueger series to the third order on WGS 84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    lam = F.radians(lon - (utm_zone(lon) * 6 - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return k0 * big * east + 500_000, k0 * big * north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def snap(value: Column, step: float) -> Column:
    """The nearest multiple of step, half to even, to 8 places."""
    return F.round(F.rint(value / step) * step, 8)


def tangent(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a nearby origin, on its tangent plane."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((px - ax) * dx + (py - ay) * dy) / size).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))
