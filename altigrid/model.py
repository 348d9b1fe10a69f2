"""Table shapes shared by every operator.

A *cell table* has one row per grid cell: ``scene, row, col, v`` (plus ``layer`` where several grids
of a scene travel together). It is dense: each cell of the scene rectangle has a row and a missing
height is NULL. Row 0 is north. A *scenes* table has one row per scene with its size, pixel size,
CRS and affine transform.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["scene", "row", "col"]
NODATA = -9999.0
CONTRACT_VERSION = 4
PARTS_PER_CORE = 4

CELL_SCHEMA = T.StructType(
    [
        T.StructField("scene", T.LongType(), False),
        T.StructField("layer", T.StringType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("v", T.DoubleType(), True),
    ]
)
AFFINE = T.StructType([T.StructField(n, T.DoubleType()) for n in "abcdef"])
META_SCHEMA = T.StructType(
    [
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("pixel_size_m", T.DoubleType()),
        T.StructField("pixel_size_assumed", T.BooleanType()),
        T.StructField("min_h", T.DoubleType()),
        T.StructField("max_h", T.DoubleType()),
        T.StructField("units", T.StringType()),
        T.StructField("crs", T.StringType()),
        T.StructField("bounds", T.ArrayType(T.DoubleType())),
        T.StructField("has_mask", T.BooleanType()),
        T.StructField("dem_file", T.StringType()),
        T.StructField(
            "calibration",
            T.StructType(
                [
                    T.StructField("method", T.StringType()),
                    T.StructField("confidence", T.StringType()),
                    T.StructField("dem_source", T.StringType()),
                ]
            ),
        ),
        T.StructField("source_name", T.StringType()),
    ]
)


def finite(c: Column | str) -> Column:
    """The value as DOUBLE, with NaN and infinities turned into NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def scene_extent(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Height and width of every scene, measured from its cells (map-side combined)."""
    return cells.groupBy(*(by or ["scene"])).agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")
    )


def attach(big: DataFrame, dim: DataFrame, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join per-scene (per-group) values back onto cells.

    No hint and no copies of the per-group side: its true size decides whether it is broadcast. Where it is too
    large for that, Spark's adaptive skew join divides a scene that holds most of the cells.
    """
    return big.join(dim, on or ["scene"], how)


def cell_parts(spark: SparkSession) -> int:
    """Partitions for tables with a row per cell: the session's shuffle partitions, and some for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)


def meet(a: DataFrame, b: DataFrame, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join of two tables with a row per cell, sorted and merged.

    Stored or shuffled, regular cells take a hundredth of their size in memory, which the planner goes by; left to it,
    a grid of millions of cells would be gathered in the driver and broadcast, and shuffled partitions would be
    coalesced until a core has one, however many cells that makes. So the number of partitions is given; cells that
    lie in as many by the same key are not shuffled again.
    """
    on = on or KEY
    n = cell_parts(a.sparkSession)
    return a.repartition(n, *on).join(b.repartition(n, *on).hint("merge"), on, how)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, as the cluster names it in ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    return path


def session_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/altigrid-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Drop this application's intermediate tables once its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result to reliable storage and continue from there.

    Used before iterative fits: the rounds then re-read a small stored table, and a lost executor
    costs one task instead of the whole chain.
    """
    return cut_measured(df, F.count(F.lit(1)).alias("rows"))[0]


def cut_measured(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut` that also returns aggregates of the rows, observed while they are written."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    seen = Observation()
    df.observe(seen, *measures).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get
