"""Per-cell terrain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col, clip

OBJECT_MIN_HEIGHT_M = 2.5
SLOPE_SATURATION_DEG = 60.0


def object_mask(dsm, dtm, min_h: float = OBJECT_MIN_HEIGHT_M) -> Column:
    """Taller than ``min_h`` above bare ground; unknown heights are not objects."""
    return F.coalesce(as_col(dsm) - as_col(dtm) > min_h, F.lit(False))


def local_xz(row, col, h, w, px) -> Column:
    """Metres east (x) and south (z) of the grid centre, at the cell centre."""
    x = (as_col(col) + 0.5 - as_col(w) / 2) * as_col(px)
    z = (as_col(row) + 0.5 - as_col(h) / 2) * as_col(px)
    return F.struct(x.alias("x"), z.alias("z"))


def uv(row, col, h, w) -> Column:
    """Texture coordinates of the cell centre, v = 1 at the north edge."""
    return F.struct(
        ((as_col(col) + 0.5) / as_col(w)).alias("u"), (1.0 - (as_col(row) + 0.5) / as_col(h)).alias("v")
    )


def display_height(v, units, h, w, px) -> Column:
    """Metres as they are; relative heights scaled to a tenth of the longer ground side."""
    side = F.greatest(as_col(h), as_col(w)) * as_col(px)
    return F.when(as_col(units) == "relative", as_col(v) * 0.1 * side).otherwise(as_col(v))


def slope_degrees(gx, gy) -> Column:
    return F.degrees(F.atan(F.hypot(as_col(gx), as_col(gy))))


def unit_normal(gx, gy) -> Column:
    """Surface normal (x east, y up, z south) from the two gradients."""
    gx, gy = as_col(gx), as_col(gy)
    length = F.sqrt(gx * gx + gy * gy + 1.0)
    return F.struct((-gx / length).alias("nx"), (1.0 / length).alias("ny"), (-gy / length).alias("nz"))


def shade(gx, gy, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Shaded relief in 0..1 for a light at ``azimuth``/``altitude`` degrees."""
    gx, gy = as_col(gx), as_col(gy)
    tilt = F.atan(F.hypot(gx, gy))
    facing = F.atan2(-gx, gy)
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = F.sin(alt) * F.cos(tilt) + F.cos(alt) * F.sin(tilt) * F.cos(az - facing)
    return clip(light, 0.0, 1.0)


def signed_share(err, clamp) -> Column:
    """Error as a share of ``clamp`` in -1..1; NULL stays NULL."""
    return clip(as_col(err) / F.greatest(as_col(clamp), F.lit(1e-6)), -1.0, 1.0)
