"""Composite jobs (V1-V4): lazy chains of operators over all scenes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altigrid.functions.labels import datum_of
from altigrid.functions.terrain import object_mask
from altigrid.model import KEY, attach, cut, finite, scene_extent, meet
from altigrid.operators import evaluation, joins, metrics, resample, tiling
from altigrid.operators.calibration import CalibrationConfig, method_b, to_geoid
from altigrid.operators.stretch import normalize_relative


def calibrate(
    d: DataFrame, scenes: DataFrame, dem_layers: DataFrame, target: DataFrame, cfg: CalibrationConfig = CalibrationConfig(),
    gcps: DataFrame | None = None, undulation: DataFrame | None = None, kernel: str = "bilinear", sigma: float | None = None,
    invalid: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """V1: relative depth plus elevation tiles to heights for every scene.

    ``scenes``: scene, h, w, pixel_m, dem_res_m, source. ``dem_layers``: scene, row, col, v, layer,
    priority on the elevation grid. ``target``: scene, h, w, src, dst (affines of the elevation and
    the image grid). A scene whose elevation model covers nothing falls back to relative heights with
    a warning. Returns cells (with ``mode``) and one record per scene.

    ``invalid``: scene, row, col of image cells that hold no picture; they are missing in the result and stay
    out of the percentiles of relative scenes. ``gcps`` are points in pixel coordinates (``geo.place_points``).
    Where ``scenes`` has ``n_scale, n_offset``, the undulation is stored in these units.
    """
    coarse = joins.mosaic(dem_layers).select(*KEY, "v")
    dem = cut(resample.resample(coarse, target, kernel))
    share = metrics.coverage(dem, ["scene"])
    s = scenes.join(share, "scene", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    s = cut(s)
    metric, relative = s.where("coverage > 0"), s.where("coverage = 0")
    meta = metric.withColumn("datum", datum_of("source"))
    if undulation is not None:
        units = {n: F.coalesce(F.col(n).cast("double"), F.lit(one)) if n in scenes.columns else F.lit(one) for n, one in (("n_scale", 1.0), ("n_offset", 0.0))}
        geo = metric.withColumns(units)
        dem, converted = to_geoid(dem, undulation, geo)
        meta = converted.drop("n_scale", "n_offset", "converted")
    d_metric = d.join(metric.select("scene"), "scene", "left_semi")
    dem_metric = dem.join(metric.select("scene"), "scene", "left_semi")
    dsm, cal = method_b(d_metric, dem_metric, metric, cfg, gcps, sigma=sigma)
    d_relative = d.join(relative.select("scene"), "scene", "left_semi")
    if invalid is not None:
        dsm, d_relative = joins.apply_mask(dsm, invalid), joins.apply_mask(d_relative, invalid)
    flat = normalize_relative(d_relative)
    cells = dsm.select(*KEY, "v", F.lit("absolute").alias("mode")).unionByName(flat.select(*KEY, "v", F.lit("relative").alias("mode")))
    partial = F.when(F.col("coverage") < 1, F.format_string("%.1f%% of the cells have an elevation", F.col("coverage") * 100))
    records = meta.join(cal, "scene").select(
        "scene", F.lit("absolute").alias("mode"), "method", "confidence", "scale", F.col("source").alias("dem_source"), "datum", partial.alias("warning")
    )
    missing = relative.select(
        "scene", F.lit("relative").alias("mode"), F.lit("none").alias("method"), F.lit("n/a").alias("confidence"), F.lit(None).cast("double").alias("scale"),
        F.lit(None).cast("string").alias("dem_source"), F.lit(None).cast("string").alias("datum"), F.lit("without elevations the heights are relative").alias("warning"),
    )
    return cells, records.unionByName(missing)


def evaluate(
    predictions: DataFrame, refs: DataFrame, dtms: DataFrame, tiles: DataFrame, scenes: DataFrame, cal_a: DataFrame, cal_b: DataFrame,
    min_height: float = 2.5, relative: DataFrame | None = None,
) -> DataFrame:
    """V2: per-tile result rows of three methods against references.

    ``predictions``: scene, row, col, dem, method_a, method_b. ``tiles``: scene, tile, row0, row1,
    col0, col1. ``scenes``: scene, landscape. References are joined last, for scoring only.

    ``tiles`` may have ``mode`` (A6): tiles that are ``metric`` are scored by method, those that are
    ``relative`` after scale alignment (E4) on ``relative``: scene, row, col, v; others are left out.
    """
    wanted = None
    if "mode" in tiles.columns:
        if relative is None:
            raise ValueError("tiles with a mode need the relative grids")
        wanted, tiles = tiles.where("mode = 'relative'").drop("mode"), tiles.where("mode = 'metric'").drop("mode")
    wide = meet(meet(predictions, refs.select(*KEY, F.col("v").alias("ref"))), dtms.select(*KEY, F.col("v").alias("_dtm")))
    wide = wide.withColumn("is_object", object_mask("ref", "_dtm", min_height)).drop("_dtm")
    placed = joins.cells_in_tiles(wide, tiles).drop("row0", "row1", "col0", "col1")
    stacked = evaluation.stack_methods(placed, cal_a, cal_b)
    rows = evaluation.score_tiles(stacked, ["scene", "tile"])
    if wanted is not None:
        grids = joins.join_cells(relative, refs)
        found = metrics.relative_metrics(joins.cells_in_tiles(grids, wanted), "pred", "ref", ["scene", "tile"])
        # a tile without common cells still counts
        found = wanted.select("scene", "tile").join(found, ["scene", "tile"], "left")
        null = F.lit(None)
        rows = rows.unionByName(found.select(
            "scene", "tile", F.lit("relative").alias("method"), F.lit("scale-aligned").alias("cal_source"), F.col("align_a").alias("scale"), *metrics.METRICS,
            F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), F.lit(0).cast("bigint").alias("ndsm_pixels"), null.cast("double").alias("ndsm_rmse")))
    return rows.join(scenes.select("scene", "landscape"), "scene")


METRIC_METHODS = ["dem_only", "method_a", "method_b"]


def evaluate_summary(per_tile: DataFrame, method: str = "method_b", n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V2 roll-up: landscape summary of the metric methods, the worst tiles, and the relative tiles' summary."""
    stored = cut(per_tile)
    return evaluation.summarize(stored, METRIC_METHODS), evaluation.worst_tiles(stored, method, n), evaluation.summarize_relative(stored)


def validate(pred: DataFrame, ref: DataFrame, meta: DataFrame, mask: DataFrame, grids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V3: metrics of finished grids against references, and the error and reference layers.

    ``meta``: scene, units. Relative grids are scored after scale alignment and their reference is
    expressed in relative units; cells of ``mask`` (filled ones) stay out of both layers. Scenes
    with fewer than two common cells carry an ``error``.

    ``grids``: scene, src, dst (affines of the reference and the result, same CRS) of georeferenced
    scenes; their reference is resampled onto the result's grid. Other scenes are compared cell by
    cell, so a reference of another size gives an ``error`` and no layers. A reference without a height on
    the result's grid misses it, which is an ``error`` of its own.
    """
    extent = cut(scene_extent(pred))
    other = scene_extent(ref).select("scene", F.col("h").alias("_h"), F.col("w").alias("_w"))
    plain = extent
    if grids is not None:
        placed = cut(grids.where("src is not null and dst is not null").select("scene", "src", "dst"))
        plain = extent.join(placed, "scene", "left_anti")
    sizes = cut(plain.join(other, "scene").select("scene", ((F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))).alias("_fits")))
    aligned = attach(ref.select(*KEY, "v"), sizes.where("_fits").select("scene"), how="left_semi")
    if grids is not None:
        aligned = aligned.unionByName(resample.resample(ref, extent.join(placed, "scene")))
    pairs = attach(joins.join_cells(pred, aligned), meta.select("scene", "units"))
    fit = cut(metrics.affine_fit(pairs.where("units = 'relative'"), "pred", "ref", ["scene"]))
    x = attach(pairs, fit, how="left")
    scored = F.when(F.col("units") == "relative", F.col("align_a") * F.col("pred") + F.col("align_b")).otherwise(F.col("pred"))
    m = metrics.dsm_metrics(x.withColumn("_s", scored), "_s", "ref", ["scene"])
    met = pairs.groupBy("scene").agg(F.count(finite("ref")).alias("_met"))
    report = meta.select("scene", "units").join(m, "scene", "left").join(met, "scene", "left")
    report = report.join(sizes, "scene", "left").withColumn("scale_aligned", F.col("units") == "relative").withColumn(
        "error", F.when(~F.col("_fits"), "the reference has another size and the scene no georeference").when(
            F.coalesce("_met", F.lit(0)) == 0, "the reference lies beside the result").when(
            F.coalesce("n_pixels", F.lit(0)) < 2, "too few cells are valid in both grids")
    ).drop("_fits", "_met")
    shown = F.when(F.col("units") == "relative", F.try_divide(F.col("ref") - F.col("align_b"), F.col("align_a"))).otherwise(F.col("ref"))
    refs = joins.apply_mask(x.select(*KEY, "pred", shown.alias("v")), mask)
    layers = refs.select(*KEY, F.col("v").alias("reference"), (F.col("pred") - F.col("v")).alias("error"))
    return report, layers


def build_site(
    items: DataFrame, sites: DataFrame, image_cells, surface_cells, ground_cells, tile_px: int, min_valid: float, min_coverage: float = 0.999,
) -> DataFrame:
    """V4: evaluation tiles of every site from a catalogue of images and height tiles.

    ``items`` and ``sites`` carry degree boxes; ``items`` also ``item, ts``; ``sites`` also
    ``scene, h, w``. The three callables turn matched items into cells on the site grid: images to
    scene, row, col, item, priority, r, g, b; heights to scene, row, col, layer, priority, v.

    Sites with one box and grid size are one place: it is built once, under its smallest ``scene``, and its tiles
    are given to all of them. Matched items have ``_place``, their number in their scene by ``item``; cells
    that keep it are taken in that order and meet no join before their mosaic is made.
    """
    box = ["west", "south", "east", "north", "h", "w"]
    places = cut(sites.groupBy(*box).agg(F.min("scene").alias("scene")))
    matched = joins.newest_footprints(items, places).select("scene", "item", "ts")
    newest = cut(joins.number_layers(matched, "item", "item"))
    image, report = joins.mosaic_images(image_cells(newest), min_coverage)
    surface = joins.mosaic(surface_cells(newest)).select(*KEY, "v")
    ground = joins.mosaic(ground_cells(newest)).select(*KEY, F.col("v").alias("dtm"))
    accepted = report.where("accepted").select("scene")
    on_site = meet(meet(image.select(*KEY), surface, how="left"), ground, how="left")
    extent = places.select("scene", "h", "w").join(accepted, "scene", "left_semi")
    tiles = tiling.cut_tiles(on_site, tile_px, min_valid, extent).withColumnRenamed("scene", "_first")
    members = sites.select("scene", *box).distinct().join(places.withColumnRenamed("scene", "_first"), box).select("scene", "_first")
    return members.join(tiles, "_first").drop("_first")
