"""Spatial operators on lat/lon columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bounding_box(points: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    return points.where(F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon))


def radius_search(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Points within a distance: a latitude and longitude window first, which reaches the scan, then the exact rule."""
    dlat = math.degrees(km / EARTH_KM)
    near = points.where(F.col("lat").between(lat - dlat, lat + dlat))
    widest = max(abs(lat - dlat), abs(lat + dlat))
    if widest < 89.9:
        dlon = math.degrees(math.asin(min(1.0, math.sin(min(km / EARTH_KM, math.pi / 2)) / math.cos(math.radians(lat))))) if abs(lat) < 89.9 else 180.0
        if lon - dlon >= -180 and lon + dlon <= 180:
            near = near.where(F.col("lon").between(lon - dlon, lon + dlon))
    d = haversine(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    return near.withColumn("km", d).where(F.col("km") <= km)


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lat / degrees).cast("long"), F.floor(lon / degrees).cast("long")


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """(a, b, km) of points within a distance of each other.

    Points meet only inside a grid cell: one side stays in its cell and the
    other visits the neighbouring cells, so the join is an equality on cells.
    Longitude cells are sized for the widest latitude in use (60 degrees).
    """
    size = max(math.degrees(km / EARTH_KM) * 2, 1e-6)
    ci, cj = cell(F.col("lat"), F.col("lon"), size)
    here = points.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), ci.alias("i"), cj.alias("j"))
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    there = points.select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("lp"), F.explode(F.transform(steps, lambda s: s + ci)).alias("i"), cj.alias("cj"))
    there = there.select("b", "lb", "lp", "i", F.explode(F.transform(steps, lambda s: s + F.col("cj"))).alias("j"))
    d = haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return here.join(there, ["i", "j"]).where("a < b").select("a", "b", d.alias("km")).where(F.col("km") <= km)
