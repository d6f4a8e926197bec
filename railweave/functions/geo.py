"""Distances, walking and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
WALK_KMH = 5.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arcsine form, clamped against rounding."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would skip a NULL and make an unknown point the antipode.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def planar_m2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared metres on a plane, for cheap prefilters."""
    dy = (lat1 - lat2) * 111000.0
    dx = (lon1 - lon2) * 111000.0 * (1.0 - 0.0000152 * lat1 * lat1)
    return dx * dx + dy * dy


def walk_minutes(km: Column) -> Column:
    """Whole minutes at walking speed, rounded up."""
    return F.ceil(km / WALK_KMH * 60).cast("int")


def walk_radius_km(minutes: Column | float) -> Column:
    return (F.lit(minutes) if not isinstance(minutes, Column) else minutes) / 60.0 * WALK_KMH


def walk_transfer_minutes(metres: Column) -> Column:
    """Minutes of a transfer: whole minutes of walking and two more."""
    return (F.floor(metres / 5000.0 * 60) + 2).cast("int")


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Struct of the cell's row and column."""
    return F.struct(F.floor(lat / degrees).cast("int").alias("r"), F.floor(lon / degrees).cast("int").alias("c"))


def geo_cell(lat: Column, lon: Column, degrees: float = 0.01) -> Column:
    """The cell packed into one long."""
    return F.shiftleft(F.floor(lat / degrees).cast("long"), 32).bitwiseOR(F.floor(lon / degrees).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def neighbour_cells(lat: Column, lon: Column, degrees: float, reach: int = 1) -> Column:
    """Array of the packed cells around a point's cell, its own included."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return F.array(*[geo_cell(lat + i * degrees, lon + j * degrees, degrees) for i, j in steps])


def geo_cache_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f,%.4f", lat, lon)
