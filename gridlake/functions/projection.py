"""Map projections as column expressions: forward from degrees to metres, inverse back.

Transverse Mercator follows Krueger's series in the third flattening n, to the fourth order."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS 84 and the universal transverse Mercator grid
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
SPHERE = 6371007.181        # radius of the sinusoidal tiles of 1 km products

THIRD = FLATTENING / (2 - FLATTENING)


def _series(*rows):
    return tuple(sum(c * THIRD ** (i + k) for k, c in enumerate(row)) for i, row in enumerate(rows, 1))


#: Half of the rectified meridian's length over pi, and the coefficients of the three series.
RECTIFIED = AXIS / (1 + THIRD) * (1 + THIRD ** 2 / 4 + THIRD ** 4 / 64)
TO_GRID = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
FROM_GRID = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
TO_LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _sum(terms) -> Column:
    terms = list(terms)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


@dataclass(frozen=True)
class LonLat:
    """Degrees as they are."""

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


@dataclass(frozen=True)
class UTM:
    """A zone of the universal transverse Mercator grid."""
    zone: int
    south: bool = False

    @property
    def meridian(self) -> float:
        return 6.0 * self.zone - 183.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e = 2 * math.sqrt(THIRD) / (1 + THIRD)
        s, d = F.sin(F.radians(lat)), F.radians(lon - F.lit(self.meridian))
        t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x = eta + _sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(TO_GRID, 1))
        y = xi + _sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(TO_GRID, 1))
        k = F.lit(SCALE * RECTIFIED)
        return F.lit(FALSE_EASTING) + k * x, k * y + F.lit(FALSE_NORTHING if self.south else 0.0)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        k = F.lit(SCALE * RECTIFIED)
        xi, eta = (y - F.lit(FALSE_NORTHING if self.south else 0.0)) / k, (x - F.lit(FALSE_EASTING)) / k
        p = xi - _sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(FROM_GRID, 1))
        q = eta - _sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(FROM_GRID, 1))
        chi = F.asin(F.sin(p) / F.cosh(q))
        lat = chi + _sum(c * F.sin(2 * j * chi) for j, c in enumerate(TO_LATITUDE, 1))
        return F.lit(self.meridian) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


@dataclass(frozen=True)
class Sinusoidal:
    """Equal-area on a sphere, as tiled 1 km products are stored."""
    radius: float = SPHERE

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        r = F.lit(self.radius)
        return r * F.radians(lon) * F.cos(F.radians(lat)), r * F.radians(lat)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        r = F.lit(self.radius)
        return F.degrees(x / (r * F.cos(y / r))), F.degrees(y / r)


@dataclass(frozen=True)
class WebMercator:
    """Spherical Mercator of web maps."""

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.lit(AXIS) * F.radians(lon), F.lit(AXIS) * F.atanh(F.sin(F.radians(lat)))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / F.lit(AXIS)), F.degrees(F.asin(F.tanh(y / F.lit(AXIS))))
