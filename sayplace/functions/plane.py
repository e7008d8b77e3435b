"""Plane geometry: the equal-area projection of a sphere, its inverse, and distances on the sphere."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius in metres.
RADIUS = 6371008.8


@dataclass(frozen=True)
class Projection:
    """Lambert's azimuthal equal-area projection about a centre in degrees."""

    lat: float = 54.9
    lng: float = -3.4

    @property
    def sin(self) -> float:
        return math.sin(math.radians(self.lat))

    @property
    def cos(self) -> float:
        return math.cos(math.radians(self.lat))

    def to_plane(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        """Metres east and north of the centre; null at its antipode, which the plane doesn't have."""
        p, turn = F.radians(lat), F.radians(lng) - math.radians(self.lng)
        facing = F.lit(1.0) + self.sin * F.sin(p) + self.cos * F.cos(p) * F.cos(turn)
        scale = F.sqrt(F.lit(2.0) / F.nullif(facing, F.lit(0.0)))
        return RADIUS * scale * F.cos(p) * F.sin(turn), RADIUS * scale * (self.cos * F.sin(p) - self.sin * F.cos(p) * F.cos(turn))

    def to_sphere(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees of latitude and longitude of a point of the plane."""
        rho = F.hypot(x, y)
        far = F.nullif(rho, F.lit(0.0))
        c = 2 * F.asin(rho / (2 * RADIUS))
        lat = F.asin(F.cos(c) * self.sin + y * F.sin(c) * self.cos / far)
        lng = math.radians(self.lng) + F.atan2(x * F.sin(c), far * self.cos * F.cos(c) - y * self.sin * F.sin(c))
        return F.when(rho == 0, F.lit(self.lat)).otherwise(F.degrees(lat)), F.when(rho == 0, F.lit(self.lng)).otherwise(F.degrees(lng))


def great_circle(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Metres along the sphere, by haversines."""
    rise, turn = F.radians(lat_b - lat_a), F.radians(lng_b - lng_a)
    h = F.pow(F.sin(rise / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(turn / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def wrapped(lng: Column) -> Column:
    """A longitude brought into [-180, 180)."""
    return F.pmod(lng + 180, F.lit(360.0)) - 180
