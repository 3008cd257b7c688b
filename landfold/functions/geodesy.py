"""Geographic to projected coordinates as closed-form Column series.

Fixed values: WGS 84 and International 1924 ellipsoids, the seven-parameter
shift between them and the transverse Mercator of the EPSG:2326 grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import Vec

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
INTL24_A, INTL24_F = 6378388.0, 1 / 297.0
# Datum shift to WGS 84 (position vector): metres, arc-seconds, parts per million.
SHIFT = dict(tx=-162.619, ty=-276.959, tz=-161.764, rx=0.067753, ry=-2.243649, rz=-1.158827, ppm=-1.094246)
GRID = dict(lat0=22.312133333333335, lon0=114.17855555555556, k0=1.0, e0=836694.05, n0=819069.80)


def geodetic_to_ecef(lon, lat, h, a: float = WGS84_A, f: float = WGS84_F) -> Vec:
    """Longitude and latitude in radians, ellipsoidal height in metres."""
    e2 = f * (2 - f)
    n = F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + h) * F.sin(lat)


def meridian_coefficients(f: float) -> tuple[float, float, float, float]:
    e2 = f * (2 - f)
    return (
        1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2**3 / 256,
        3 / 8 * (e2 + e2 * e2 / 4 + 15 * e2**3 / 128),
        15 / 256 * (e2 * e2 + 3 * e2**3 / 4),
        35 * e2**3 / 3072,
    )


# The chains below add their intermediate values as columns, one projection per
# step: nested into a single expression they would be copied at every use.

def _ecef_to_geodetic(df: DataFrame, x, y, z, lon: str, lat: str, h: str, a: float, f: float) -> DataFrame:
    """Bowring's closed form; longitude and latitude in radians."""
    b = a * (1 - f)
    e2, ep2 = f * (2 - f), (a * a - b * b) / (b * b)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumn("_p", F.sqrt(x * x + y * y)).withColumn("_th", F.atan2(z * a, F.col("_p") * b))
    df = df.withColumns({"_s": F.sin("_th"), "_c": F.cos("_th")})
    s, c = F.col("_s"), F.col("_c")
    df = df.withColumn("_lat", F.atan2(z + ep2 * b * s * s * s, F.col("_p") - e2 * a * c * c * c))
    df = df.withColumn("_n", F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin("_lat") * F.sin("_lat")))
    df = df.withColumns({lon: F.atan2(y, x), lat: F.col("_lat"), h: F.col("_p") / F.cos("_lat") - F.col("_n")})
    return df.drop("_x", "_y", "_z", "_p", "_th", "_s", "_c", "_lat", "_n")


def _to_grid_datum(df: DataFrame, x, y, z) -> DataFrame:
    """WGS 84 earth-centred to the grid's datum: inverse shift, linear in the small angles."""
    sec = math.pi / 180 / 3600
    rx, ry, rz = SHIFT["rx"] * sec, SHIFT["ry"] * sec, SHIFT["rz"] * sec
    s = 1 + SHIFT["ppm"] * 1e-6
    df = df.withColumns({"_dx": (x - SHIFT["tx"]) / s, "_dy": (y - SHIFT["ty"]) / s, "_dz": (z - SHIFT["tz"]) / s})
    dx, dy, dz = F.col("_dx"), F.col("_dy"), F.col("_dz")
    return _ecef_to_geodetic(
        df, dx + dy * rz - dz * ry, dy - dx * rz + dz * rx, dz + dx * ry - dy * rx,
        "_glon", "_glat", "_gh", INTL24_A, INTL24_F,
    ).drop("_dx", "_dy", "_dz", "_gh")


def _transverse_mercator(df: DataFrame, easting: str, northing: str) -> DataFrame:
    a, f = INTL24_A, INTL24_F
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    a0, a2, a4, a6 = meridian_coefficients(f)
    lat0, lon0 = math.radians(GRID["lat0"]), math.radians(GRID["lon0"])
    m0 = a * (a0 * lat0 - a2 * math.sin(2 * lat0) + a4 * math.sin(4 * lat0) - a6 * math.sin(6 * lat0))
    lat = F.col("_glat")
    df = df.withColumns({"_s": F.sin(lat), "_c": F.cos(lat)})
    s, c = F.col("_s"), F.col("_c")
    df = df.withColumns({
        "_n": F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * s * s), "_t": (s / c) * (s / c), "_cc": F.lit(ep2) * c * c,
        "_d": (F.col("_glon") - F.lit(lon0)) * c,
        "_m": F.lit(a) * (F.lit(a0) * lat - F.lit(a2) * F.sin(lat * 2) + F.lit(a4) * F.sin(lat * 4) - F.lit(a6) * F.sin(lat * 6)),
    })
    n, t, cc, d, m = (F.col(k) for k in ("_n", "_t", "_cc", "_d", "_m"))
    df = df.withColumn("_d2", d * d)
    d2 = F.col("_d2")
    df = df.withColumns({
        easting: n * (d + (F.lit(1.0) - t + cc) * d2 * d / 6
                      + (F.lit(5.0) - t * 18 + t * t + cc * 72 - F.lit(58 * ep2)) * d2 * d2 * d / 120) * GRID["k0"] + GRID["e0"],
        northing: (m - F.lit(m0) + n * (s / c) * (
            d2 / 2 + (F.lit(5.0) - t + cc * 9 + cc * cc * 4) * d2 * d2 / 24
            + (F.lit(61.0) - t * 58 + t * t + cc * 600 - F.lit(330 * ep2)) * d2 * d2 * d2 / 720)) * GRID["k0"] + GRID["n0"],
    })
    return df.drop("_glon", "_glat", "_s", "_c", "_n", "_t", "_cc", "_d", "_m", "_d2")


def wgs84_to_grid(df: DataFrame, lon: str, lat: str, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Adds grid metres for degrees on WGS 84."""
    x, y, z = geodetic_to_ecef(F.radians(lon), F.radians(lat), F.lit(0.0))
    df = df.withColumns({"_ex": x, "_ey": y, "_ez": z})
    df = _to_grid_datum(df, F.col("_ex"), F.col("_ey"), F.col("_ez")).drop("_ex", "_ey", "_ez")
    return _transverse_mercator(df, easting, northing)


def ecef_to_local(df: DataFrame, xyz: tuple[str, str, str], origin_e: float, origin_n: float, out=("lx", "ly", "lz")) -> DataFrame:
    """Adds the local frame (x east, y ellipsoidal height, z south) of earth-centred metres."""
    df = _ecef_to_geodetic(df, *[F.col(c) for c in xyz], "_lon", "_lat2", "_h", WGS84_A, WGS84_F)
    df = df.withColumns({"_lon": F.degrees("_lon"), "_lat2": F.degrees("_lat2")})
    df = wgs84_to_grid(df, "_lon", "_lat2", "_e", "_nn")
    df = df.withColumns({out[0]: F.col("_e") - origin_e, out[1]: F.col("_h"), out[2]: F.lit(origin_n) - F.col("_nn")})
    return df.drop("_lon", "_lat2", "_h", "_e", "_nn")
