"""Sinks (B1-B5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.model import CONTRACT_VERSION, KEY, NODATA, finite, meet
from altigrid.operators.neighbourhood import fill_nearest
from altigrid.operators.resample import area_downsample


def grid_rows(cells: DataFrame, nodata: float = NODATA, tags: dict[str, str] | None = None) -> DataFrame:
    """B1 projection: single-precision heights with the nodata sentinel and provenance columns."""
    v = F.coalesce(finite("v"), F.lit(float(nodata))).cast("float")
    rest = [c for c in cells.columns if c != "v"]
    return cells.select(*rest, v.alias("v"), *[F.lit(t).alias(k) for k, t in (tags or {}).items()])


def write_grid(cells: DataFrame, path: str, layer: str, nodata: float = NODATA, tags: dict[str, str] | None = None, block: int = 256) -> None:
    """B1: partitioned by layer, clustered so that a file holds compact row ranges of few scenes."""
    out = grid_rows(cells, nodata, tags).withColumn("layer", F.lit(layer))
    out = out.repartition("scene", F.floor(F.col("row") / block)).sortWithinPartitions(*KEY)
    out.write.partitionBy("layer").parquet(path)


def bundle_tables(cells: DataFrame, scenes: DataFrame, max_side: int, terrain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """B2 without the writing: the export grid (never missing) and its metadata rows.

    ``scenes``: scene, h, w, pixel_m and descriptive columns. ``filled`` marks cells that were
    filled or are less than half covered; the height range is that of the trusted cells, or of all
    where none is trusted. A scene without a valid height is an error row in the metadata.
    """
    ext = scenes.select("scene", "h", "w")
    grid = area_downsample(cells, max_side, ext)
    if terrain is not None:
        pair = meet(cells.select(*KEY, F.col("v").alias("_dsm")), terrain.select(*KEY, F.col("v")))
        under = pair.select(*KEY, F.when(F.col("_dsm").isNotNull(), F.col("v")).alias("v"))
        dem = area_downsample(under, max_side, ext).select(*KEY, F.col("v").alias("dem"))
        grid = meet(grid, dem, how="left")
    solid = fill_nearest(grid, also="dem" if terrain is not None else None)
    solid = solid.withColumn("unreliable", ~F.col("trusted")).drop("filled")
    if terrain is not None:
        own = fill_nearest(solid.select(*KEY, F.col("dem").alias("v"))).select(*KEY, F.col("v").alias("_dem"))
        solid = meet(solid, own).withColumn("dem", F.col("_dem")).drop("_dem")
    rng = solid.groupBy("scene").agg(
        F.min(F.when(~F.col("unreliable"), F.col("v"))).alias("_lo"), F.max(F.when(~F.col("unreliable"), F.col("v"))).alias("_hi"),
        F.min("v").alias("_alo"), F.max("v").alias("_ahi"), F.max("unreliable").alias("has_mask"),
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"),
    )
    spacing = F.col("pixel_m") * 0.5 * (F.col("w") / F.col("width") + F.col("h") / F.col("height"))
    meta = scenes.join(rng, "scene").select(
        *[c for c in scenes.columns if c not in ("h", "w", "pixel_m")], F.lit(CONTRACT_VERSION).alias("contract_version"),
        "width", "height", spacing.alias("pixel_size_m"), F.coalesce("_lo", "_alo").alias("min_h"), F.coalesce("_hi", "_ahi").alias("max_h"),
        "has_mask", F.lit("dem" if terrain is not None else None).cast("string").alias("dem_file"),
        F.when(F.col("_alo").isNull(), "no valid heights to export").alias("error"),
    )
    return solid, meta


def write_bundle(cells: DataFrame, scenes: DataFrame, path: str, max_side: int = 2048, terrain: DataFrame | None = None) -> DataFrame:
    """B2: export grids as a partitioned table and one metadata JSON row per scene."""
    grid, meta = bundle_tables(cells, scenes, max_side, terrain)
    cols = [*KEY, F.col("v").cast("float").alias("v"), "unreliable"]
    if terrain is not None:
        cols.append(F.col("dem").cast("float").alias("dem"))
    grid.select(*cols).repartition("scene", F.floor(F.col("row") / 256)).sortWithinPartitions(*KEY).write.parquet(f"{path}/grid")
    meta.write.json(f"{path}/meta")
    return meta


def union_per_tile(frames: list[DataFrame]) -> DataFrame:
    """Rows with differing columns; header order is the first-seen column order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_per_tile(frames: list[DataFrame], path: str) -> None:
    union_per_tile(frames).write.csv(path, header=True)


def run_record(summary: DataFrame, run_id: str, extra: dict[str, str] | None = None) -> DataFrame:
    """One nested row, ``summary[landscape][method]`` to its metrics.

    The summary has a handful of landscapes and methods, whatever the number of tiles.
    """

    def keyed(key: str, value) -> Column:
        entries = F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))
        by_key = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        return F.map_from_entries(by_key)

    values = F.struct(*[c for c in summary.columns if c not in ("landscape", "method")])
    methods = summary.groupBy("landscape").agg(keyed("method", values).alias("m"))
    record = methods.agg(keyed("landscape", F.col("m")).alias("summary"))
    return record.select(F.lit(run_id).alias("run_id"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()], "summary")


def write_run_record(record: DataFrame, path: str) -> None:
    record.write.json(path)


def profile_columns(points: DataFrame, units: str, keys: list[str] | None = None) -> DataFrame:
    """B5 projection: unit suffixes in the header; a slope in relative units is only a proxy."""
    tilt = "deg" if units == "m" else "relative_proxy"
    return points.select(
        *(keys or []), F.col("distance").alias("distance_m"), F.col("height").alias(f"height_{units}"),
        F.col("col_f").alias("column"), F.col("row_f").alias("row"), F.col("slope").alias(f"slope_{tilt}"),
        F.col("error").alias(f"error_{units}"),
    )


def write_profile(points: DataFrame, path: str, units: str = "m") -> None:
    """CSV with blanks for missing values, one folder per line, points in order."""
    out = profile_columns(points, units, ["scene", "line", "i"]).repartition("scene", "line").sortWithinPartitions("scene", "line", "i")
    out.drop("i").write.partitionBy("scene", "line").csv(path, header=True, nullValue="")


