"""Grid scans (A1, A2) and generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altigrid.model import CELL_SCHEMA, NODATA, finite

# Geometry of the synthetic acceptance grids.
CONE_SIZE, CONE_PEAK_M, CONE_RADIUS_M = 1025, 100.0, 400.0
CORNER_SIZE, CORNER_RAISE_M = 513, 50.0
CHECKER_PX, DOT_RADIUS_PX = 64, 8
RED, BLUE, LIGHT, DARK = (220, 30, 30), (30, 60, 230), (205, 205, 200), (120, 125, 120)


def mark_missing(v: Column, nodata: float = NODATA, valid: Column | None = None) -> Column:
    """Nodata sentinel, non-finite values and masked-out cells become NULL."""
    keep = finite(v) != F.lit(float(nodata))
    if valid is not None:
        keep = keep & valid
    return F.when(keep, finite(v))


def scan_grid(spark: SparkSession, path: str, layer: str, nodata: float = NODATA) -> DataFrame:
    """A1: cells of one layer of a stored cell table; the layer filter prunes partitions."""
    cells = spark.read.schema(CELL_SCHEMA).parquet(path).where(F.col("layer") == layer)
    return cells.select("scene", "row", "col", mark_missing(F.col("v"), nodata).alias("v"))


def grid_from_arrays(df: DataFrame, row: str, values: str, scene: str = "scene") -> DataFrame:
    """A2: one array per grid row becomes cells; array position is the column."""
    return df.select(
        F.col(scene).alias("scene"), F.col(row).cast("int").alias("row"), F.posexplode(values).alias("col", "_v")
    ).select("scene", "row", "col", finite("_v").alias("v"))


def frame(spark: SparkSession, scene: int, h: int, w: int) -> DataFrame:
    """Empty ``h`` x ``w`` cell frame built on the executors."""
    n = F.col("id")
    return spark.range(h * w).select(
        F.lit(scene).cast("bigint").alias("scene"),
        F.floor(n / w).cast("int").alias("row"),
        (n % w).cast("int").alias("col"),
    )


def synthetic_height(name: str, row: Column, col: Column, h: Column, w: Column, px: Column) -> Column:
    """A13 surfaces with exactly known values: ``cone``, ``relative`` and ``corner``."""
    if name in ("cone", "relative"):
        x = (col + 0.5 - w / 2) * px
        z = (row + 0.5 - h / 2) * px
        cone = F.greatest(F.lit(0.0), CONE_PEAK_M * (1.0 - F.hypot(x, z) / CONE_RADIUS_M))
        return cone if name == "cone" else cone / CONE_PEAK_M
    if name == "corner":
        north_west = (row < F.floor(h / 4)) & (col < F.floor(w / 4))
        return F.when(north_west, CORNER_RAISE_M).otherwise(0.0)
    raise ValueError(f"Unknown synthetic grid {name!r}")


def checkerboard(row: Column, col: Column) -> Column:
    """Ground texture of the acceptance grids: 0 = light square, 1 = dark square."""
    return ((F.floor(row / CHECKER_PX) + F.floor(col / CHECKER_PX)) % 2).cast("int")


def dot(row: Column, col: Column, row0: Column, col0: Column) -> Column:
    """True inside a filled dot around (row0, col0)."""
    return F.pow(row - row0, 2) + F.pow(col - col0, 2) <= DOT_RADIUS_PX**2


def texture_rgb(name: str, row: Column, col: Column, h: Column, w: Column) -> Column:
    """Struct<r,g,b> of a synthetic grid's ground texture."""

    def paint(rgb):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", rgb)])

    base = F.when(checkerboard(row, col) == 1, paint(DARK)).otherwise(paint(LIGHT))
    if name == "corner":
        return F.when((row < F.floor(h / 4)) & (col < F.floor(w / 4)), paint(RED)).otherwise(base)
    mid_row, mid_col = F.floor(h / 2), F.floor(w / 2)
    north = dot(row, col, F.lit(DOT_RADIUS_PX), mid_col)
    return F.when(north, paint(BLUE)).when(dot(row, col, mid_row, mid_col), paint(RED)).otherwise(base)


def synthetic_grid(spark: SparkSession, name: str, size: int | None = None, scene: int = 0) -> DataFrame:
    """A whole synthetic scene with its height and texture."""
    n = size or (CORNER_SIZE if name == "corner" else CONE_SIZE)
    side = F.lit(float(n))
    cells = frame(spark, scene, n, n)
    rgb = texture_rgb(name, F.col("row"), F.col("col"), side, side)
    return cells.withColumn(
        "v", synthetic_height(name, F.col("row"), F.col("col"), side, side, F.lit(1.0))
    ).select("*", rgb.alias("_t")).select("scene", "row", "col", "v", "_t.r", "_t.g", "_t.b")
