"""Numeric column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
UNKNOWN_KM = 9999.0


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in km (arcsine form)."""
    half = _half_chord(lat_a, lon_a, lat_b, lon_b)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(half))


def haversine_atan2(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km (atan2 form, rounder radius)."""
    half = _half_chord(lat_a, lon_a, lat_b, lon_b)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(half), F.sqrt(1 - half))


def _half_chord(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(
        F.radians(lat_b)
    ) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)


def xlogx(x: Column) -> Column:
    """x ln x with 0 ln 0 = 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def g_statistic(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """G² of the 2×2 table [[a, total_a-a], [b, total_b-b]]."""
    a, b, ta, tb = (c.cast("double") for c in (a, b, total_a, total_b))
    cells = xlogx(a) + xlogx(b) + xlogx(ta - a) + xlogx(tb - b)
    margins = xlogx(ta) + xlogx(tb) + xlogx(a + b) + xlogx(ta + tb - a - b)
    return F.greatest(F.lit(0.0), 2.0 * (cells - margins + xlogx(ta + tb)))


def length_bin(n: Column, width: int = 5, top: int = 40) -> Column:
    return F.least(F.lit(top), (F.floor(n / width) * width).cast("int"))

