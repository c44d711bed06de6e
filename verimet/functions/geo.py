"""Coordinates, boxes and distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def __post_init__(self) -> None:
        if self.lat_min >= self.lat_max or self.lon_min >= self.lon_max:
            raise ValueError("a box needs lat_min < lat_max and lon_min < lon_max")

    def text(self) -> str:
        return (
            f"lat=[{self.lat_min:g}, {self.lat_max:g}] "
            f"lon=[{self.lon_min:g}, {self.lon_max:g}]"
        )

    def corners(self) -> list[tuple[float, float]]:
        """Closed ring of (lat, lon), counter-clockwise from the south-west."""
        return [
            (self.lat_min, self.lon_min),
            (self.lat_min, self.lon_max),
            (self.lat_max, self.lon_max),
            (self.lat_max, self.lon_min),
            (self.lat_min, self.lon_min),
        ]


def wrap_longitude(lon: Column) -> Column:
    """Map any longitude to [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def coordinate_key(x: Column, scale: int = 10_000) -> Column:
    """Integer key for a coordinate, so joins never compare floats."""
    return F.floor(x * float(scale) + 0.5).cast("long")


def box_text(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    return F.format_string("lat=[%.2f, %.2f] lon=[%.2f, %.2f]", lat_min, lat_max, lon_min, lon_max)


def box_polygon(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Closed five-point ring as array<struct<lat,lon>>."""
    corners = [(lat_min, lon_min), (lat_min, lon_max), (lat_max, lon_max), (lat_max, lon_min), (lat_min, lon_min)]
    return F.array(*[F.struct(la.alias("lat"), lo.alias("lon")) for la, lo in corners])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2.0
    half_lon = F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; chord length there orders pairs like distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_to_km(chord: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    return F.lit(2.0 * radius_km) * F.asin(F.least(F.lit(1.0), chord / 2.0))
