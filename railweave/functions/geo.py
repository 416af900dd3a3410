"""Distances, kilometre posts and route costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (km) and the three speeds (km/h).
EARTH_KM = 6371.0088
SPEED_HIGH = 280.0
SPEED_DEFAULT = 80.0
SPEED_WALK = 5.0


def parse_post(post: Column) -> Column:
    """B3: '602+834' is 602.834 km; anything unreadable is NULL."""
    parts = F.split(post, r"\+")
    km = F.trim(parts[0]).try_cast("double")
    metres = F.when(F.size(parts) > 1, F.trim(parts[1]).try_cast("double") / 1000.0).otherwise(0.0)
    return F.when(post != "", km + metres)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (a sphere; within 0.6 % of the ellipsoid)."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2)) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2)))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def earth_cell(lat: Column, lon: Column, size_km: float) -> Column:
    """Cube cell of a point; points nearer than ``size_km`` lie in the same or touching cells."""
    x = F.cos(F.radians(lat)) * F.cos(F.radians(lon)) * EARTH_KM
    y = F.cos(F.radians(lat)) * F.sin(F.radians(lon)) * EARTH_KM
    z = F.sin(F.radians(lat)) * EARTH_KM
    return F.struct(*[F.floor(axis / size_km).alias(name)
                      for axis, name in ((x, "cx"), (y, "cy"), (z, "cz"))])


def cost(time: Column, distance: Column, transfers: Column) -> Column:
    return F.struct(time.alias("time"), distance.alias("distance"), transfers.alias("transfers"))


def edge_cost(dist_km: Column, speed: Column, line: Column, last_line: Column) -> Column:
    """Hours, kilometres and whether the hop changes line."""
    changed = F.when(last_line.isNotNull() & (line != last_line), 1).otherwise(0)
    return cost(dist_km / speed, dist_km, changed)


def add_cost(a: Column, b: Column) -> Column:
    """B25."""
    return cost(a["time"] + b["time"], a["distance"] + b["distance"],
                a["transfers"] + b["transfers"])


def dominates(a: Column, b: Column) -> Column:
    """No worse on all three, better on one."""
    no_worse = (a["time"] <= b["time"]) & (a["distance"] <= b["distance"]) & (
        a["transfers"] <= b["transfers"])
    better = (a["time"] < b["time"]) | (a["distance"] < b["distance"]) | (
        a["transfers"] < b["transfers"])
    return no_worse & better
