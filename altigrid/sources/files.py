"""File sources: packed grids (A3), elevation tiles (A4), results catalogue (A8), metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altigrid.model import META_SCHEMA, cut, cut_measured

MAX_CELLS = 100_000_000
CATALOGUE = ["job_id", "name", "units", "width", "height", "pixel_size_m", "crs", "calibration", "finished"]


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for scene, content, width, height in pdf.itertuples(index=False, name=None):
            if len(content) != width * height * 4:
                raise ValueError(f"scene {scene}: a {width} x {height} float grid cannot be read from {len(content)} bytes")
            grid = np.frombuffer(content, dtype="<f4").reshape(height, width)
            step = max(1, 1_000_000 // width)
            for top in range(0, height, step):
                part = grid[top : top + step]
                rows, cols = np.mgrid[top : top + len(part), 0:width]
                yield pd.DataFrame({"scene": scene, "row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32"), "v": part.ravel().astype("float64")})


def decode_packed(df: DataFrame) -> DataFrame:
    """A3: ``scene, content, width, height`` to cells; little-endian float32, row-major, NaN missing.

    A wrong byte length is an error. A grid is emitted in row strips.
    """
    kind = df.schema["scene"].dataType.simpleString()
    raw = df.select("scene", "content", F.col("width").cast("int"), F.col("height").cast("int"))
    cells = raw.mapInPandas(_unpack, f"scene {kind}, row int, col int, v double")
    return cells.withColumn("v", F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v")))


def scan_packed(spark: SparkSession, path: str, name: str = "dsm.bin") -> DataFrame:
    """A3: every ``<folder>/<name>`` below ``path`` with the ``meta.json`` next to it.

    ``scene`` is the folder. The metadata is one small row per grid; the files are decoded where
    they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    files = files.select(F.regexp_replace("path", "/[^/]+$", "").alias("scene"), "content")
    meta = spark.read.schema(META_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "meta.json"
    ).json(path)
    meta = meta.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("scene"), "width", "height")
    return decode_packed(files.join(meta, "scene"))


def scan_dem_tiles(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", tile_pattern: str = r"(.*)") -> DataFrame:
    """A4: every raster part under a folder, recursively; sorted tile names give the priority.

    ``tile_pattern`` takes the tile name from a file path (default: the path itself). An empty folder
    is an error. The names come from a listing of paths that opens no file; they are ranked over ranges of
    names, and the list's own size decides how it is joined to the cells.
    """
    cells = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(path)
    cells = cells.withColumn("tile", F.regexp_extract(F.col("_metadata.file_path"), tile_pattern, 1))
    # the binary source with neither content nor length asked for lists files and reads none
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = listed.select(F.regexp_extract(F.col("_metadata.file_path"), tile_pattern, 1).alias("tile")).distinct()
    order, seen = cut_measured(ranked_over_ranges(names, "tile", "priority"), F.count(F.lit(1)).alias("tiles"))
    if not seen["tiles"]:
        raise FileNotFoundError(f"No elevation tiles in {path}.")
    return cells.join(order, "tile")


def ranked_over_ranges(names: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names numbered from 1 in order: a number within each range of names, and the ranges' offsets."""
    parts = cut(names.repartitionByRange(name).sortWithinPartitions(name).select(name, F.spark_partition_id().alias("_part")))
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(name)))
    # one row per range
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return inside.join(starts, "_part").select(name, (F.col("_at") + F.col("_start")).cast("int").alias(out))


def catalogue_rows(texts: DataFrame) -> DataFrame:
    """A8 on ``job_id, text, finished``: damaged metadata dropped, nine fields, name falls back to id."""
    schema = T.StructType([*META_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    m = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = texts.select("job_id", "finished", m.alias("m")).where(F.col("m").isNotNull() & F.col("m._corrupt_record").isNull())
    return _catalogue(parsed, F.col("m"))


def _catalogue(df: DataFrame, m: Column) -> DataFrame:
    name = F.coalesce(F.when(m["source_name"] != "", m["source_name"]), F.col("job_id"))
    return df.select(
        "job_id", name.alias("name"), m["units"].alias("units"), m["width"].cast("bigint").alias("width"), m["height"].cast("bigint").alias("height"),
        m["pixel_size_m"].alias("pixel_size_m"), m["crs"].alias("crs"), m["calibration"].alias("calibration"), "finished",
    )


def read_results(reader, root: str) -> DataFrame:
    """Metadata files as ``job_id, text, finished`` for a batch or streaming reader."""
    texts = reader.format("text").option("wholetext", True).option("pathGlobFilter", "meta.json").option("recursiveFileLookup", True).load(root)
    path = F.col("_metadata.file_path")
    return texts.select(
        F.regexp_extract(path, r"([^/]+)/out/bundle/meta\.json$", 1).alias("job_id"), F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("finished"),
    ).where("job_id <> ''")


def list_results(spark: SparkSession, root: str) -> DataFrame:
    """Every finished result under ``root/<job>/out/bundle/meta.json``, newest first."""
    return catalogue_rows(read_results(spark.read, root)).orderBy(F.desc("finished"), "job_id")


def validate_meta(df: DataFrame, json_col: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """Adds ``meta`` (units default to ``relative``) and ``error``, NULL when valid.

    Grids of more than ``max_cells`` cells are marked as errors: the limit of a viewer, not of the other operators.
    """
    is_object = F.coalesce(F.get_json_object(json_col, "$").startswith("{"), F.lit(False))
    x = df.withColumn("meta", F.when(is_object, F.from_json(json_col, META_SCHEMA)))
    f = {n: F.col(f"meta.{n}") for n in ("width", "height", "pixel_size_m", "min_h", "max_h", "units")}

    def bad_side(c: Column) -> Column:
        return c.isNull() | (c != F.floor(c)) | (c < 2)

    def unbounded(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    # the type in the JSON text itself: the schema would turn a number or an object into a text
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_col), "$.crs", "variant"))
    crs_is_text = F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    error = (
        F.when(F.col("meta").isNull(), "not a JSON object")
        .when(bad_side(f["width"]), "bad width")
        .when(bad_side(f["height"]), "bad height")
        .when(f["width"] * f["height"] > max_cells, "grid over the cell limit")
        .when(unbounded(f["pixel_size_m"]) | (f["pixel_size_m"] <= 0), "bad pixel size")
        .when(unbounded(f["min_h"]) | unbounded(f["max_h"]) | (f["min_h"] > f["max_h"]), "bad height range")
        .when(f["units"].isNotNull() & ~f["units"].isin("m", "relative"), "unknown units")
        .when(~crs_is_text, "crs is not a text")
    )
    units = F.coalesce(f["units"], F.lit("relative"))
    return x.withColumn("error", error).withColumn("meta", F.when(F.col("meta").isNotNull(), F.col("meta").withField("units", units)))
