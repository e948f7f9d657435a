"""Geodesics on the WGS 84 ellipsoid, and the vertices of extents. The iterations run in Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.geometry import utm

A, FLAT = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def _series(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))), k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))


def _turn(b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, mid: np.ndarray) -> np.ndarray:
    inner = cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
    return b * sin_s * (mid + b / 4 * inner)


def _excess(sin_a: np.ndarray, cos2: np.ndarray, s: np.ndarray, mid: np.ndarray) -> np.ndarray:
    c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    return (1 - c) * FLAT * sin_a * (s + c * np.sin(s) * (mid + c * np.cos(s) * (2 * mid**2 - 1)))


def _reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    return np.sin(u), np.cos(u)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lon", "lat")]))
def forward(lon: pd.Series, lat: pd.Series, azimuth: pd.Series, metres: pd.Series) -> pd.DataFrame:
    """Where a geodesic of a start, an azimuth (degrees from north) and a length ends."""
    lon, lat, azimuth, metres = (x.to_numpy(float) for x in (lon, lat, azimuth, metres))
    (su, cu), a1 = _reduced(lat), np.radians(azimuth)
    start, sin_a = np.arctan2(su, cu * np.cos(a1)), cu * np.sin(a1)
    cos2 = 1 - sin_a**2
    big, small = _series(cos2 * (A**2 - B**2) / B**2)
    s = metres / (B * big)
    for _ in range(12):
        s = metres / (B * big) + _turn(small, np.sin(s), np.cos(s), np.cos(2 * start + s))
    mid, sin_s, cos_s = np.cos(2 * start + s), np.sin(s), np.cos(s)
    up = su * cos_s + cu * sin_s * np.cos(a1)
    across = np.hypot(sin_a, su * sin_s - cu * cos_s * np.cos(a1))
    lam = np.arctan2(sin_s * np.sin(a1), cu * cos_s - su * sin_s * np.cos(a1))
    east = lam - _excess(sin_a, cos2, s, mid)
    return pd.DataFrame({"lon": lon + np.degrees(east), "lat": np.degrees(np.arctan2(up, (1 - FLAT) * across))})


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("metres", "azimuth")]))
def inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    """Length and first azimuth of the geodesic between two points; nulls for nearly opposite points, which don't converge."""
    lon1, lat1, lon2, lat2 = (x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))
    (s1, c1), (s2, c2), wide = _reduced(lat1), _reduced(lat2), np.radians(lon2 - lon1)
    lam, step = wide, np.zeros_like(wide)
    for _ in range(40):
        x, y = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
        sin_s, cos_s = np.hypot(x, y), s1 * s2 + c1 * c2 * np.cos(lam)
        s = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(c1 * c2 * np.sin(lam), sin_s, out=np.zeros_like(s), where=sin_s > 0)
        cos2 = 1 - sin_a**2
        mid = cos_s - np.divide(2 * s1 * s2, cos2, out=np.zeros_like(s), where=cos2 > 1e-15)
        mid = np.where(cos2 > 1e-15, mid, 0.0)
        new = wide + _excess(sin_a, cos2, s, mid)
        step, lam = np.abs(new - lam), new
    big, small = _series(cos2 * (A**2 - B**2) / B**2)
    metres = B * big * (s - _turn(small, sin_s, cos_s, mid))
    azimuth = np.degrees(np.arctan2(x, y)) % 360
    lost = ~(step < 1e-10)
    return pd.DataFrame({"metres": np.where(lost, np.nan, metres), "azimuth": np.where(lost, np.nan, azimuth)})


def disk(centres: DataFrame, chord_m: float = 0.25) -> DataFrame:
    """(id, seq, lon, lat): the vertices of geodesic disks (id, lon, lat, metres), 64 to 512 of them, chords within ``chord_m`` of the arc where that is enough."""
    n = F.ceil(F.pi() / F.acos(1 - F.least(F.lit(chord_m) / F.col("metres"), F.lit(0.5))))
    n = F.least(F.greatest(n, F.lit(64)), F.lit(512))
    turned = centres.withColumn("_n", n).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    at = turned.withColumn("_at", forward("lon", "lat", F.col("seq") * 360.0 / F.col("_n"), F.col("metres").cast("double")))
    return at.select("id", "seq", F.col("_at.lon").alias("lon"), F.col("_at.lat").alias("lat"))


def utm_inverse(east: Column, north: Column, origin_lon: float, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres in the zone of the origin: the inverse of ``utm``, by Krueger's series of third order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    centre = math.floor((origin_lon + 180) / 6) * 6 - 177
    xi, eta = (north - (10_000_000 if south else 0)) / radius, (east - 500_000) / radius
    up, across = xi, eta
    for j, b in enumerate(beta, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        across = across - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(across))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return centre + F.degrees(F.atan2(F.sinh(across), F.cos(up))), F.degrees(lat)


def square(centres: DataFrame, origin_lon: float, south: bool = False, step_m: float = 25.0) -> DataFrame:
    """(id, seq, lon, lat): the vertices of squares (id, lon, lat, half in metres) along the UTM axes, one every ``step_m`` metres or less."""
    half = F.col("half").cast("double")
    east, north = utm(F.col("lon"), F.col("lat"), origin_lon, south)
    each = F.greatest(F.ceil(2 * half / step_m), F.lit(1))
    placed = centres.withColumns({"_e": east, "_n": north, "_k": each}).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), 4 * each - 1)))
    side, t = F.floor(F.col("seq") / F.col("_k")), (F.col("seq") % F.col("_k")) / F.col("_k")
    run = half * (2 * t - 1)
    dx = F.when(side == 0, run).when(side == 1, half).when(side == 2, -run).otherwise(-half)
    dy = F.when(side == 0, -half).when(side == 1, run).when(side == 2, half).otherwise(-run)
    lon, lat = utm_inverse(F.col("_e") + dx, F.col("_n") + dy, origin_lon, south)
    return placed.select("id", "seq", lon.alias("lon"), lat.alias("lat"))
