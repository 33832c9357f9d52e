"""Angles in degrees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight sectors from north, clockwise.
SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def wrap(deg: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(deg.cast("double"), F.lit(360.0))


def components(deg: Column) -> tuple[Column, Column]:
    """Sine and cosine."""
    return F.sin(F.radians(deg)), F.cos(F.radians(deg))


def direction(sin: Column, cos: Column, least: float = 1e-12) -> Column:
    """Degrees of a vector; null when it has hardly any length."""
    return F.when(F.hypot(sin, cos) > least, wrap(F.degrees(F.atan2(sin, cos))))


def difference(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod((a - b + 180.0).cast("double"), F.lit(360.0)) - 180.0)


def mean_direction(deg: Column) -> Column:
    """Aggregate: circular mean; null when directions cancel."""
    s, c = components(deg)
    return direction(F.avg(s), F.avg(c), 1e-9)


def circular_variance(deg: Column) -> Column:
    """Aggregate: 1 less the mean resultant length."""
    s, c = components(deg)
    return 1 - F.hypot(F.avg(s), F.avg(c))


def interpolate(a: Column, b: Column, weight: Column) -> Column:
    """Direction on the chord from a to b."""
    (sa, ca), (sb, cb) = components(a), components(b)
    return direction(sa * (1 - weight) + sb * weight, ca * (1 - weight) + cb * weight)


def speed_direction(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed of a current and where it flows to."""
    return F.hypot(u, v), wrap(F.degrees(F.atan2(u, v)))


def sector(deg: Column) -> Column:
    """One of eight sectors centred on SECTORS."""
    at = F.floor(wrap(deg + 22.5) / 45).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, SECTORS)), at)
