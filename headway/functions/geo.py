"""Distances, boxes, the local projection and an equal-distance grid, all as native expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sphere radius, city origin and degree lengths of the flat projection.
EARTH_RADIUS_M = 6_371_000.0
CITY_ORIGIN = (12.9716, 77.5946)
METERS_PER_DEG_LAT = 111_320.0
METERS_PER_DEG_LON = 110_540.0


class Box(NamedTuple):
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


# Service area of each feed, bounds included.
FEED_BOXES: dict[str, Box] = {
    "bmtc": Box(12.6, 13.3, 77.2, 77.9),
    "namma_metro": Box(28.4, 28.9, 76.8, 77.4),
}
STOPS_BOX = FEED_BOXES["bmtc"]

DEG_PER_M = 180.0 / (math.pi * EARTH_RADIUS_M)
#: No two points are farther apart.
HALF_ROUND_M = math.pi * EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null when any coordinate is null."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = (F.pow(F.sin(half_dlat), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), F.lit(2.0)))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``haversine(lat1, lon1, lat2, lon2)`` callable from SQL text, without Python."""
    h = ("(pow(sin(radians(lat2 - lat1) / 2), 2)"
         " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION haversine(
            lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN {2 * EARTH_RADIUS_M}D * atan2(sqrt({h}), sqrt(1D - {h}))
    """)


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    return lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)


def in_feed_box(feed: Column, lat: Column, lon: Column,
                boxes: Mapping[str, Box] = FEED_BOXES) -> Column:
    """True inside the box of the row's own feed; false for an unknown feed."""
    hit = F.lit(False)
    for name, box in boxes.items():
        hit = hit | ((feed == name) & in_box(lat, lon, box))
    return F.coalesce(hit, F.lit(False))


def on_globe(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def planar_xz(lat: Column, lon: Column, origin: tuple[float, float] = CITY_ORIGIN,
              deg_lat_m: float = METERS_PER_DEG_LAT,
              deg_lon_m: float = METERS_PER_DEG_LON) -> tuple[Column, Column]:
    """Metres east (x) and north (z) of the origin on a flat map."""
    return (lon - F.lit(origin[1])) * F.lit(deg_lon_m), (lat - F.lit(origin[0])) * F.lit(deg_lat_m)


def near_latitude(lat1: Column, lat2: Column, radius_m: float) -> Column:
    """Cheap necessary condition for two points to lie within a radius."""
    return F.abs(lat1 - lat2) <= F.lit(radius_m * 1.001 * DEG_PER_M)


# Grid. Bands of equal height run along the parallels; every band is cut into a whole number of
# cells that are at least one cell size wide at the band's narrowest edge. A disc touches a few
# neighbouring cells only, also across the date line and at the poles.

def _band(lat: Column, size_m: float) -> Column:
    return F.floor((lat + F.lit(90.0)) / F.lit(size_m * DEG_PER_M))


def _cells_in_band(band: Column, size_m: float) -> Column:
    height = size_m * DEG_PER_M
    edge = F.greatest(F.abs(band * F.lit(height) - F.lit(90.0)),
                      F.abs((band + F.lit(1)) * F.lit(height) - F.lit(90.0)))
    around = F.cos(F.radians(F.least(edge, F.lit(90.0)))) * F.lit(360.0 / height)
    return F.greatest(F.floor(around), F.lit(1).cast("long"))


def _cell_ordinal(lon: Column, cells: Column) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * cells)


def with_cell(df: DataFrame, lat: str, lon: str, size_m: float) -> DataFrame:
    """Add ``_band`` and ``_cell``, the one grid cell a point lies in."""
    df = df.withColumn("_band", _band(F.col(lat), size_m))
    cells = _cells_in_band(F.col("_band"), size_m)
    return df.withColumn("_cell", F.pmod(_cell_ordinal(F.col(lon), cells), cells))


def with_cover(df: DataFrame, lat: str, lon: str, radius_m: float, size_m: float) -> DataFrame:
    """Repeat each row for every grid cell that its disc of ``radius_m`` touches."""
    reach_m = radius_m * 1.001 + 1.0
    reach_deg = reach_m * DEG_PER_M
    top = math.floor(180.0 / (size_m * DEG_PER_M))
    low = F.greatest(_band(F.col(lat) - F.lit(reach_deg), size_m), F.lit(0).cast("long"))
    high = F.least(_band(F.col(lat) + F.lit(reach_deg), size_m), F.lit(top).cast("long"))
    half_width = F.when(
        F.abs(F.col(lat)) + F.lit(reach_deg) < F.lit(89.9),
        F.degrees(F.asin(F.lit(math.sin(math.radians(reach_deg))) / F.cos(F.radians(F.col(lat))))),
    ).otherwise(F.lit(180.0))
    columns = df.columns
    df = df.withColumn("_half", half_width).withColumn("_band", F.explode(F.sequence(low, high)))
    df = df.withColumn("_cells", _cells_in_band(F.col("_band"), size_m))
    west = _cell_ordinal(F.col(lon) - F.col("_half"), F.col("_cells"))
    east = _cell_ordinal(F.col(lon) + F.col("_half"), F.col("_cells"))
    east = F.least(east, west + F.col("_cells") - F.lit(1))
    df = df.withColumn("_raw", F.explode(F.sequence(west, east)))
    return df.select(*columns, "_band", F.pmod("_raw", "_cells").alias("_cell"))
