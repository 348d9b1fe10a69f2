"""Stored grids in strips: one row per grid row and column block, bucketed and sorted by that key.

A strip is ``scene, row, cb, v``: the values of the columns ``cb * STRIP`` onwards, in order, missing as
NULL. Grids stored with the same number of buckets meet strip by strip without a shuffle: the storage
partitioning is the join's partitioning. A strip holds at most ``STRIP`` values, so one wide or hot
scene is as many strips as it needs, dealt over all buckets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altigrid.model import KEY, scratch_path, meet

STRIP = 1024
STRIP_KEY = ["scene", "row", "cb"]
BUCKET_CELLS = 2_000_000


def to_strips(cells: DataFrame, value: str = "v") -> DataFrame:
    """Cells to strips. Columns without a cell, up to the last of the strip, are missing values."""
    at = (F.col("col") % STRIP).cast("int")
    entry = F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))
    packed = cells.groupBy("scene", "row", F.floor(F.col("col") / STRIP).cast("int").alias("cb")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    last = F.element_at("e", -1)["at"]
    known = F.map_from_entries("e")
    spread = F.transform(F.sequence(F.lit(0), last), lambda i: F.try_element_at(known, i))
    # nearly always every column is there
    v = F.when(F.size("e") == last + 1, F.col("e.v")).otherwise(spread)
    return packed.select(*STRIP_KEY, v.alias("v"))


def store_grid(cells: DataFrame, name: str, buckets: int | None = None, value: str = "v") -> DataFrame:
    """Write a grid as a bucketed table of the session's shared folder and return its strips.

    ``buckets`` follows from the number of cells where it is not given; grids that are to be joined
    need the same number. The key is unique, so buckets are even whatever the scenes' sizes.
    """
    spark = cells.sparkSession
    n = buckets or bucket_count(cells)
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_").lower()
    strips = to_strips(cells, value).repartition(n, *STRIP_KEY)
    strips.write.bucketBy(n, *STRIP_KEY).sortBy(*STRIP_KEY).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def bucket_count(cells: DataFrame) -> int:
    """Buckets for about ``BUCKET_CELLS`` cells each, but no fewer than the session's shuffle partitions."""
    return max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells.count() / BUCKET_CELLS))


def open_grid(spark: SparkSession, table: str) -> DataFrame:
    """Strips of a table that an earlier application stored in the catalogue."""
    return spark.table(table).select(*STRIP_KEY, "v")


def is_strips(df: DataFrame) -> bool:
    return set(STRIP_KEY) <= set(df.columns) and isinstance(df.schema["v"].dataType, T.ArrayType)


def cells_of(strips: DataFrame) -> DataFrame:
    """Strips back to cells."""
    x = strips.select("scene", "row", "cb", F.posexplode("v").alias("_at", "v"))
    return x.select("scene", "row", (F.col("cb") * STRIP + F.col("_at")).cast("int").alias("col"), "v")


def beside(grids: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    """Cells of several grids side by side: ``scene, row, col`` and one column per grid.

    Stored grids meet strip by strip (no exchange if their buckets agree); other grids meet by cell.
    With ``left`` the cells of the first grid decide, else those that all have.
    """
    if not all(is_strips(g) for g in grids.values()):
        sides = [(cells_of(g) if is_strips(g) else g).select(*KEY, F.col("v").alias(n)) for n, g in grids.items()]
        return reduce(lambda a, b: meet(a, b, how=how), sides)
    sides = [g.select(*STRIP_KEY, F.col("v").alias(n)) for n, g in grids.items()]
    met = reduce(lambda a, b: a.join(b, STRIP_KEY, how), sides)
    names = list(grids)
    reach: Column = F.size(names[0]) if how == "left" or len(names) == 1 else F.least(*[F.size(n) for n in names])
    at = met.select(*STRIP_KEY, *names, F.explode(F.sequence(F.lit(0), reach - 1)).alias("_at"))
    return at.select("scene", "row", (F.col("cb") * STRIP + F.col("_at")).cast("int").alias("col"), *[F.get(n, F.col("_at")).alias(n) for n in names])
