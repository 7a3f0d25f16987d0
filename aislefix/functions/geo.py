"""Distances on the sphere, in metres."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aislefix.settings import EARTH_RADIUS_M


def great_circle(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Haversine distance between two points given in degrees."""
    half_lon = F.radians(lon_b - lon_a) / 2
    half_lat = F.radians(lat_b - lat_a) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M)


def equator_arc(degrees_a: Column, degrees_b: Column) -> Column:
    """Distance along the equator between two angles, the short way round.

    Used for both axes: the great-circle formula with the other axis at zero.
    """
    zero = F.lit(0.0)
    return great_circle(degrees_a, zero, degrees_b, zero)
