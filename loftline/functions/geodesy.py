"""Local coordinates: azimuthal equidistant projection on the WGS84 ellipsoid, by Vincenty's formulae (1975).

Tables are projected by column expressions; inverse() and direct() are the same for arrays, with as many rounds as it takes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)


def _series(u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _correction(b, sin_s, cos_s, mid):
    return b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))


def inverse(lat0, lon0, lat, lon) -> tuple[np.ndarray, np.ndarray]:
    """Distance in metres and azimuth in radians from the first point.  Raises for points nearly opposite."""
    with np.errstate(invalid="ignore", divide="ignore"):
        u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat0, lat))
        way = np.radians(np.asarray(lon, float) - np.asarray(lon0, float))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        turn = way.copy()
        for _ in range(200):
            x, y = c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn)
            sin_s, cos_s = np.hypot(x, y), s1 * s2 + c1 * c2 * np.cos(turn)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * np.sin(turn) / np.where(sin_s > 0, sin_s, 1), 0.0)
            cos2a = 1 - sin_a**2
            mid = np.where(cos2a > 0, cos_s - 2 * s1 * s2 / np.where(cos2a > 0, cos2a, 1), 0.0)
            c = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
            new = way + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(new - turn), initial=0) < 1e-13
            turn = new
            if done:
                break
        else:
            raise ValueError("points are nearly opposite each other")
        big, small = _series(cos2a * (A**2 - B**2) / B**2)
        distance = B * big * (sigma - _correction(small, sin_s, cos_s, mid))
        return distance, np.arctan2(x, y)


def direct(lat0, lon0, distance, azimuth) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees of the point at a distance and azimuth."""
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(np.asarray(lat0, float))))
    sin_z, cos_z, s1, c1 = np.sin(azimuth), np.cos(azimuth), np.sin(u1), np.cos(u1)
    start, sin_a = np.arctan2(np.tan(u1), cos_z), c1 * sin_z
    cos2a = 1 - sin_a**2
    big, small = _series(cos2a * (A**2 - B**2) / B**2)
    first = np.asarray(distance, float) / (B * big)
    sigma = first
    for _ in range(50):
        mid, sin_s, cos_s = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
        new = first + _correction(small, sin_s, cos_s, mid)
        done = np.nanmax(np.abs(new - sigma), initial=0) < 1e-14
        sigma = new
        if done:
            break
    mid, sin_s, cos_s = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
    lat = np.arctan2(s1 * cos_s + c1 * sin_s * cos_z, (1 - FLATTENING) * np.hypot(sin_a, s1 * sin_s - c1 * cos_s * cos_z))
    way = np.arctan2(sin_s * sin_z, c1 * cos_s - s1 * sin_s * cos_z)
    c = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
    way -= (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
    return np.degrees(lat), np.asarray(lon0, float) + np.degrees(way)


#: Rounds of the columns' iteration: each makes the error about 300 times smaller, so six leave less than a nanometre.
ROUNDS = 6


def _bigs(u2: Column) -> tuple[Column, Column]:
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _arc_correction(b: Column, sin_s: Column, cos_s: Column, mid: Column) -> Column:
    return b * sin_s * (mid + b / 4 * (cos_s * (2 * mid * mid - 1) - b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))


def _over(x: Column, y: Column) -> Column:
    """x / y; 0 where y isn't above 0."""
    return F.when(y > 0, x / F.when(y > 0, y).otherwise(1.0)).otherwise(0.0)


def _flattened(c: Column) -> Column:
    return FLATTENING / 16 * c * (4 + FLATTENING * (4 - 3 * c))


def to_local(df: DataFrame, lat: str, lon: str, lat0: Column, lon0: Column) -> DataFrame:
    """Adds x_m (east) and y_m (north) of the origin: columns only, a fixed number of rounds.

    Null where a coordinate is, and for a point so nearly opposite the origin that the rounds don't settle.
    """
    reduced = lambda x: F.atan((1 - FLATTENING) * F.tan(F.radians(x)))
    c = lambda n: F.col(f"_{n}")
    rows = df.withColumns({"_u1": reduced(lat0), "_u2": reduced(F.col(lat)), "_way": F.radians(F.col(lon) - lon0)})
    rows = rows.withColumns({"_s1": F.sin("_u1"), "_c1": F.cos("_u1"), "_s2": F.sin("_u2"), "_c2": F.cos("_u2"), "_turn": F.col("_way")})
    for k in range(ROUNDS):
        rows = rows.withColumns({"_x": c("c2") * F.sin("_turn"), "_y": c("c1") * c("s2") - c("s1") * c("c2") * F.cos("_turn"), "_cs": c("s1") * c("s2") + c("c1") * c("c2") * F.cos("_turn")})
        rows = rows.withColumn("_ss", F.sqrt(c("x") * c("x") + c("y") * c("y")))
        rows = rows.withColumns({"_sigma": F.atan2("_ss", "_cs"), "_sa": _over(c("c1") * c("c2") * F.sin("_turn"), c("ss"))})
        rows = rows.withColumn("_ca", 1 - c("sa") * c("sa"))
        rows = rows.withColumns({"_mid": F.when(c("ca") > 0, c("cs") - _over(2 * c("s1") * c("s2"), c("ca"))).otherwise(0.0), "_f": _flattened(c("ca"))})
        new = c("way") + (1 - c("f")) * FLATTENING * c("sa") * (c("sigma") + c("f") * c("ss") * (c("mid") + c("f") * c("cs") * (2 * c("mid") * c("mid") - 1)))
        rows = rows.withColumns({"_turn": new, "_step": F.abs(new - c("turn"))} if k == ROUNDS - 1 else {"_turn": new})
    big, small = _bigs(c("ca") * ((A**2 - B**2) / B**2))
    rows = rows.withColumn("_way", F.when(c("step") < 1e-11, B * big * (c("sigma") - _arc_correction(small, c("ss"), c("cs"), c("mid")))))
    azimuth = F.atan2("_x", "_y")
    return rows.withColumns({"x_m": c("way") * F.sin(azimuth), "y_m": c("way") * F.cos(azimuth)}).drop(*(f"_{n}" for n in ("u1", "u2", "way", "s1", "c1", "s2", "c2", "turn", "x", "y", "cs", "ss", "sigma", "sa", "ca", "mid", "f", "step")))


def to_globe(df: DataFrame, x: str, y: str, lat0: Column, lon0: Column) -> DataFrame:
    """Adds lat_deg and lon_deg: columns only, a fixed number of rounds.  Null where a coordinate is."""
    c = lambda n: F.col(f"_{n}")
    rows = df.withColumns({"_u1": F.atan((1 - FLATTENING) * F.tan(F.radians(lat0))), "_z": F.atan2(F.col(x), F.col(y)), "_far": F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))})
    rows = rows.withColumns({"_s1": F.sin("_u1"), "_c1": F.cos("_u1"), "_sz": F.sin("_z"), "_cz": F.cos("_z"), "_start": F.atan2(F.tan("_u1"), F.cos("_z"))})
    rows = rows.withColumn("_sa", c("c1") * c("sz")).withColumn("_ca", 1 - c("sa") * c("sa"))
    big, small = _bigs(c("ca") * ((A**2 - B**2) / B**2))
    rows = rows.withColumns({"_first": c("far") / (B * big), "_small": small}).withColumn("_sigma", c("first"))
    for _ in range(ROUNDS):
        rows = rows.withColumn("_sigma", c("first") + _arc_correction(c("small"), F.sin("_sigma"), F.cos("_sigma"), F.cos(2 * c("start") + c("sigma"))))
    rows = rows.withColumns({"_ss": F.sin("_sigma"), "_cs": F.cos("_sigma"), "_mid": F.cos(2 * c("start") + c("sigma")), "_f": _flattened(c("ca"))})
    down = c("s1") * c("ss") - c("c1") * c("cs") * c("cz")
    lat = F.atan2(c("s1") * c("cs") + c("c1") * c("ss") * c("cz"), (1 - FLATTENING) * F.sqrt(c("sa") * c("sa") + down * down))
    way = F.atan2(c("ss") * c("sz"), c("c1") * c("cs") - c("s1") * c("ss") * c("cz"))
    way -= (1 - c("f")) * FLATTENING * c("sa") * (c("sigma") + c("f") * c("ss") * (c("mid") + c("f") * c("cs") * (2 * c("mid") * c("mid") - 1)))
    found = rows.withColumns({"lat_deg": F.degrees(lat), "lon_deg": lon0 + F.degrees(way)})
    return found.drop(*(f"_{n}" for n in ("u1", "z", "far", "s1", "c1", "sz", "cz", "start", "sa", "ca", "first", "small", "sigma", "ss", "cs", "mid", "f")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
