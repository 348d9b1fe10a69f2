"""Coordinates as Column expressions: affine grids, UTM zones and the Krueger series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col, clip

# WGS 84 ellipsoid and the UTM grid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_K0, UTM_E0, UTM_N0_SOUTH = 0.9996, 500000.0, 10000000.0
UTM_SOUTH, UTM_NORTH = -80.0, 84.0

_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_CONFORMAL = 2 * _N**0.5 / (1 + _N)
# Fourth-order Krueger coefficients (published): forward, inverse, latitude.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def pixel_to_world(t: Column, col, row) -> Column:
    """Affine struct<a,b,c,d,e,f> applied to pixel coordinates."""
    col, row = as_col(col), as_col(row)
    return F.struct(
        (t["a"] * col + t["b"] * row + t["c"]).alias("x"), (t["d"] * col + t["e"] * row + t["f"]).alias("y")
    )


def world_to_pixel(t: Column, x, y) -> Column:
    """Inverse affine; NULL for a degenerate transform."""
    dx, dy = as_col(x) - t["c"], as_col(y) - t["f"]
    det = t["a"] * t["e"] - t["b"] * t["d"]
    return F.struct(
        F.try_divide(t["e"] * dx - t["b"] * dy, det).alias("col"),
        F.try_divide(t["a"] * dy - t["d"] * dx, det).alias("row"),
    )


def scale_transform(t: Column, sx, sy) -> Column:
    """Transform of the same ground extent with pixels ``sx`` x ``sy`` times as large."""
    sx, sy = as_col(sx), as_col(sy)
    return F.struct(
        (t["a"] * sx).alias("a"), (t["b"] * sy).alias("b"), t["c"].alias("c"),
        (t["d"] * sx).alias("d"), (t["e"] * sy).alias("e"), t["f"].alias("f"),
    )


def is_georeferenced(crs, t: Column) -> Column:
    """A CRS plus a transform that is not the identity."""
    identity = (
        (t["a"] == 1) & (t["b"] == 0) & (t["c"] == 0) & (t["d"] == 0) & (t["e"] == 1) & (t["f"] == 0)
    )
    return as_col(crs).isNotNull() & F.coalesce(~identity, F.lit(False))


def utm_epsg(lon, lat) -> Column:
    """EPSG code of the WGS 84 UTM zone, zone kept within 1..60."""
    zone = clip(F.floor((as_col(lon) + 180.0) / 6.0) + 1, 1, 60)
    return (F.when(as_col(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def _central_meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6.0 - 183.0)


def _false_northing(epsg: Column) -> Column:
    return F.when(epsg >= 32700, UTM_N0_SOUTH).otherwise(0.0)


def add_utm(df: DataFrame, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> DataFrame:
    """C9 forward: adds ``x, y`` in metres (Krueger series, fourth order).

    The series is laid out as a chain of columns, so that shared terms are computed once.
    """
    d = df.withColumn("_lam", F.radians(lon) - _central_meridian(F.col(epsg))).withColumn("_s", F.sin(F.radians(lat)))
    d = d.withColumn("_t", F.sinh(F.atanh("_s") - _CONFORMAL * F.atanh(_CONFORMAL * F.col("_s"))))
    t = F.col("_t")
    d = d.withColumn("_xi", F.atan2(t, F.cos("_lam"))).withColumn("_eta", F.atanh(F.sin("_lam") / F.sqrt(1.0 + t * t)))
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    scale = UTM_K0 * _RECTIFYING
    d = d.withColumn(x, UTM_E0 + scale * east).withColumn(y, _false_northing(F.col(epsg)) + scale * north)
    return d.drop("_lam", "_s", "_t", "_xi", "_eta")


def add_lonlat(df: DataFrame, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """C9 inverse: adds ``lon, lat`` in degrees."""
    scale = UTM_K0 * _RECTIFYING
    d = df.withColumn("_xi", (F.col(y) - _false_northing(F.col(epsg))) / scale).withColumn("_eta", (F.col(x) - UTM_E0) / scale)
    xi, eta = F.col("_xi"), F.col("_eta")
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        eta1 = eta1 - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    d = d.withColumn("_xi1", xi1).withColumn("_eta1", eta1)
    d = d.withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    chi = F.col("_chi")
    phi = chi
    for j, c in enumerate(DELTA, 1):
        phi = phi + c * F.sin(2.0 * j * chi)
    lam = _central_meridian(F.col(epsg)) + F.atan2(F.sinh("_eta1"), F.cos("_xi1"))
    d = d.withColumn(lon, F.degrees(lam)).withColumn(lat, F.degrees(phi))
    return d.drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


def place_points(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """C5, C9 on control points: adds ``row_f, col_f`` (cell centres at .5) and drops points outside their scene.

    ``points``: scene with ``x, y`` in the scene's own CRS or ``lon, lat`` in degrees; ``scenes``: scene, h, w,
    epsg, t (affine). A scene in degrees (4326) takes longitude and latitude as they are.
    """
    s = scenes.select("scene", *[F.col(c).alias(f"_scene_{c}") for c in ("h", "w", "epsg", "t")])
    p = points.join(s, "scene")
    if {"x", "y"} <= set(points.columns):
        p = p.withColumn("_px", F.col("x")).withColumn("_py", F.col("y"))
    else:
        p = add_utm(p, "lon", "lat", "_scene_epsg", "_ux", "_uy")
        degrees = F.col("_scene_epsg") == 4326
        p = p.withColumn("_px", F.when(degrees, F.col("lon")).otherwise(F.col("_ux"))).withColumn("_py", F.when(degrees, F.col("lat")).otherwise(F.col("_uy")))
    at = world_to_pixel(F.col("_scene_t"), "_px", "_py")
    p = p.withColumn("col_f", at["col"]).withColumn("row_f", at["row"])
    inside = (F.col("col_f") >= 0) & (F.col("col_f") < F.col("_scene_w")) & (F.col("row_f") >= 0) & (F.col("row_f") < F.col("_scene_h"))
    return p.where(inside).select(*points.columns, "row_f", "col_f")


def add_center(df: DataFrame, t: str, epsg: str, h: str, w: str) -> DataFrame:
    """Adds the grid centre ``mid_lon, mid_lat``; ``epsg`` 4326 means the grid is in degrees."""
    mid = pixel_to_world(F.col(t), F.col(w) / 2.0, F.col(h) / 2.0)
    d = df.withColumn("_mx", mid["x"]).withColumn("_my", mid["y"])
    d = add_lonlat(d, "_mx", "_my", epsg, "_mlon", "_mlat")
    deg = F.col(epsg) == 4326
    d = d.withColumn("mid_lon", F.when(deg, F.col("_mx")).otherwise(F.col("_mlon")))
    d = d.withColumn("mid_lat", F.when(deg, F.col("_my")).otherwise(F.col("_mlat")))
    return d.drop("_mx", "_my", "_mlon", "_mlat")


def within_turn(df: DataFrame, t: str, h: str, w: str, degrees: Column) -> DataFrame:
    """Moves grids in degrees by whole turns so that their centre lies within 180 degrees east and west; others stay as they are."""
    own = F.col(t)
    mid = pixel_to_world(own, F.col(w) / 2.0, F.col(h) / 2.0)["x"]
    beyond = degrees & (F.abs(mid) > 180.0)
    moved = own["c"] - 360.0 * F.floor((mid + 180.0) / 360.0)
    return df.withColumn(t, F.struct(own["a"].alias("a"), own["b"].alias("b"), F.when(beyond, moved).otherwise(own["c"]).alias("c"), *[own[n].alias(n) for n in "def"]))


def add_ground_sides(df: DataFrame, t: str, epsg: str, h: str, w: str) -> DataFrame:
    """Adds ``dx, dy``, the east-west and north-south ground size of the centre pixel, and
    ``pixel_m`` (the finer side) and ``res_m`` (their geometric mean)."""
    cx, cy = F.col(w) / 2.0, F.col(h) / 2.0
    d = df
    for i, (px, py) in enumerate(((cx, cy), (cx + 1.0, cy), (cx, cy + 1.0))):
        p = pixel_to_world(F.col(t), px, py)
        d = d.withColumn(f"_lon{i}", p["x"]).withColumn(f"_lat{i}", p["y"])
    d = d.withColumn("_gz", utm_epsg("_lon0", "_lat0"))
    for i in range(3):
        d = add_utm(d, f"_lon{i}", f"_lat{i}", "_gz", f"_x{i}", f"_y{i}")
    deg = F.col(epsg) == 4326

    def side(i: int, own: str) -> Column:
        far = F.hypot(F.col(f"_x{i}") - F.col("_x0"), F.col(f"_y{i}") - F.col("_y0"))
        return F.when(deg, far).otherwise(F.abs(F.col(t)[own]))

    d = d.withColumn("dx", side(1, "a")).withColumn("dy", side(2, "e"))
    d = d.withColumn("pixel_m", F.least("dx", "dy")).withColumn("res_m", F.sqrt(F.col("dx") * F.col("dy")))
    return d.drop("_gz", *[f"_{n}{i}" for n in ("lon", "lat", "x", "y") for i in range(3)])


def bounds(t: Column, h, w) -> Column:
    """west, south, east, north of a north-up grid as an array."""
    tl, br = pixel_to_world(t, F.lit(0.0), F.lit(0.0)), pixel_to_world(t, as_col(w), as_col(h))
    return F.array(
        F.least(tl["x"], br["x"]), F.least(tl["y"], br["y"]), F.greatest(tl["x"], br["x"]), F.greatest(tl["y"], br["y"])
    )
