"""Geometry and geodesy as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius; WGS 84 ellipsoid; UTM scale, false easting.
EARTH_M = 6_371_000.0
WGS_A, WGS_F, UTM_K0, UTM_E0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def utm(lat: Column, lon: Column, zone: int = 43) -> tuple[Column, Column]:
    """(easting, northing) on the northern half of a UTM zone, by the Krüger series."""
    n = WGS_F / (2 - WGS_F)
    radius = WGS_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return UTM_E0 + UTM_K0 * radius * east, UTM_K0 * radius * north


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a line segment; the foot is clipped to its ends."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over an array of structs (x, y); points on the boundary are not decided by it."""
    n = F.size(ring)
    crosses = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            (F.element_at(ring, i).y > py) != (F.element_at(ring, i % n + 1).y > py),
            (px < (F.element_at(ring, i % n + 1).x - F.element_at(ring, i).x) * (py - F.element_at(ring, i).y) / (F.element_at(ring, i % n + 1).y - F.element_at(ring, i).y) + F.element_at(ring, i).x).cast("int"),
        ).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda a, x: a + x) % 2 == 1


def to_boundary(x: Column, y: Column, width: float, height: float) -> Column:
    """Distance to the edge of a rectangle from the origin."""
    return F.least(x, y, F.lit(width) - x, F.lit(height) - y)
