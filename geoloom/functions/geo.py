"""Affine grids and the transverse Mercator projection as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS 84 ellipsoid, UTM scale and false origin.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series to the third order of n.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def central_meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def _atanh(x: Column) -> Column:
    return F.ln((1 + x) / (1 - x)) / 2


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) of geographic degrees."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _A * x, (FALSE_NORTHING_SOUTH if south else 0.0) + SCALE * _A * y


def from_utm(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    xi0 = (northing - (FALSE_NORTHING_SOUTH if south else 0.0)) / (SCALE * _A)
    eta0 = (easting - FALSE_EASTING) / (SCALE * _A)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def box_from_utm(left: Column, bottom: Column, right: Column, top: Column, zone: int, south: bool = False, points: int = 3) -> tuple[Column, Column, Column, Column]:
    """Bounding box (left, bottom, right, top) in degrees of a projected box, its edges sampled at
    ``points`` places each."""
    share = [i / (points - 1) for i in range(points)]
    places = [(left + (right - left) * s, y) for s in share for y in (bottom, top)] + [(x, bottom + (top - bottom) * s) for s in share for x in (left, right)]
    there = [from_utm(x, y, zone, south) for x, y in places]
    lon, lat = [p[0] for p in there], [p[1] for p in there]
    return F.least(*lon), F.least(*lat), F.greatest(*lon), F.greatest(*lat)


def window_bounds(x: Column, y: Column, size: int, transform: Column) -> Column:
    """struct(left, bottom, right, top) of a window at pixel (x, y) of a north-up raster."""
    a, c, e, f = (transform[k] for k in "acef")
    return F.struct((c + a * x).alias("left"), (f + e * (y + size)).alias("bottom"), (c + a * (x + size)).alias("right"), (f + e * y).alias("top"))


def centroid(left: Column, bottom: Column, right: Column, top: Column) -> tuple[Column, Column]:
    return (left + right) / 2, (bottom + top) / 2


def pixel_range(left: Column, bottom: Column, right: Column, top: Column, transform: Column, height: Column, width: Column) -> Column:
    """struct(r0, r1, c0, c1): half-open pixel rows and columns of a box, clamped to the raster and
    put in order; a box off the raster has an empty range."""
    a, c, e, f = (transform[k] for k in "acef")

    def index(v: Column, origin: Column, step: Column) -> Column:
        return F.floor((v - origin) / step).cast("int")

    r0, r1 = F.greatest(F.lit(0), index(top, f, e)), F.least(height, index(bottom, f, e))
    c0, c1 = F.greatest(F.lit(0), index(left, c, a)), F.least(width, index(right, c, a))
    return F.struct(F.least(r0, r1).alias("r0"), F.greatest(r0, r1).alias("r1"), F.least(c0, c1).alias("c0"), F.greatest(c0, c1).alias("c1"))
