"""Metric calibration against a coarse elevation model.

Never reads reference surfaces: nothing here may import the metrics or evaluation modules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.functions.labels import CONVERTED_DATUM, ELLIPSOIDAL_SOURCES, datum_of
from altigrid.functions.numbers import pearson
from altigrid.model import KEY, attach, cut, cut_measured, meet
from altigrid.operators.blur import band_split, gaussian
from altigrid.operators.ranks import quantiles
from altigrid.operators.resample import sample_points

FLOAT32_EPS = 1.1920928955078125e-07
RELIEF_OFF = 1e9
STILL = 1e-11


@dataclass(frozen=True)
class CalibrationConfig:
    band_sigma_k: float = 1.0
    huber_delta_m: float = 2.0
    gcp_min_points: int = 3
    band_coarse_cells: float = 4.0
    band_min_r: float = 0.1
    band_min_cells: int = 64
    dem_relief_std_m: float = RELIEF_OFF
    prior_percentile: float = 98.0
    prior_height_m: float = 0.0


def block_size() -> Column:
    """Cells per elevation-model cell, at least one (half-even rounding)."""
    return F.greatest(F.lit(1), F.rint(F.col("dem_res_m") / F.col("pixel_m")).cast("int"))


def block_means(cells: DataFrame, values: list[str], block: int | DataFrame) -> DataFrame:
    """Means of full ``block`` x ``block`` squares for several value columns in one aggregate.

    A square with any missing cell is missing; incomplete squares at the far edges are dropped.
    ``block`` is a number or a per-scene frame ``scene, block``.
    """
    if isinstance(block, DataFrame):
        x = attach(cells, block)
    else:
        x = cells.withColumn("block", F.lit(int(block)))
    n = F.max("block") * F.max("block")
    at = [F.floor(F.col(p) / F.col("block")).cast("int").alias(p) for p in ("row", "col")]
    g = x.groupBy("scene", *at).agg(
        (F.count(F.lit(1)) == n).alias("_full"),
        *[F.when(F.count(v) == n, F.avg(v)).alias(v) for v in values],
    )
    return g.where("_full").drop("_full")


def block_mean(cells: DataFrame, block: int | DataFrame) -> DataFrame:
    """See :func:`block_means`."""
    return block_means(cells, ["v"], block)


def huber_affine(df: DataFrame, x: str, y: str, by: list[str], delta: float = 2.0, rounds: int = 20) -> DataFrame:
    """Huber fit ``y = a*x + b`` per group by iteratively reweighted least squares.

    At most ``rounds`` rounds from the least-squares start, weights ``min(1, delta/|residual|)``, on
    centred values. A group whose line moves by less than ``STILL`` of its size in a round is done and takes
    part in no further one; what more rounds would change is below that. A round is one combinable aggregate over a stored table, so a group of any size is never gathered. A group
    without spread in ``x`` (or with one pair) gets ``a = 0`` and the median of ``y``. Runs when called.
    """
    ok = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ))
    stats = cut(ok.groupBy(*by).agg(
        F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), (F.max("_x") > F.min("_x")).alias("_varies"),
    ))
    centred = cut(attach(ok, stats.where("_varies"), by).select(
        *by, (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y")
    ))
    fits = _reweighted(centred, by, delta, rounds)
    out = fits.join(stats, by).select(*by, "a", (F.col("b") + F.col("_my") - F.col("a") * F.col("_mx")).alias("b"))
    level = stats.where(~F.col("_varies")).select(*by)
    flat = quantiles(ok.join(level, by, "left_semi"), by, {"b": ("_y", 0.5)})
    return out.unionByName(flat.select(*by, F.lit(0.0).alias("a"), "b"))


def _reweighted(centred: DataFrame, by: list[str], delta: float, rounds: int) -> DataFrame:
    """The rounds: one aggregate each; the few parameters are stored between rounds."""
    x, y = F.col("_x"), F.col("_y")
    params = cut(centred.groupBy(*by).agg((F.sum(x * y) / F.sum(x * x)).alias("a"), F.lit(0.0).alias("b")))
    done = []
    for _ in range(rounds):
        off = F.abs(F.col("a") * x + F.col("b") - y)
        g = attach(centred, params, by).withColumn("_w", F.when(off > delta, delta / off).otherwise(1.0))
        w = F.col("_w")
        s = g.groupBy(*by).agg(
            F.first("a").alias("_a"), F.first("b").alias("_b"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
            F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"),
        )
        a = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
        s = s.withColumn("a", a).withColumn("b", (F.col("sy") - F.col("a") * F.col("sx")) / F.col("sw"))
        near = [F.abs(F.col(p) - F.col(f"_{p}")) <= STILL * F.greatest(F.abs(p), F.lit(1.0)) for p in "ab"]
        s = s.withColumn("_still", near[0] & near[1])
        stored, seen = cut_measured(s.select(*by, "a", "b", "_still"), F.count_if(~F.col("_still")).alias("moving"), F.count_if("_still").alias("still"))
        params = stored.where(~F.col("_still")).select(*by, "a", "b")
        if seen["still"]:
            done.append(stored.where("_still").select(*by, "a", "b"))
        if not seen["moving"]:
            break
    return reduce(DataFrame.unionByName, done, params)


def _pairs(d: DataFrame, dem: DataFrame) -> DataFrame:
    return meet(d.select(*KEY, F.col("v").alias("x")), dem.select(*KEY, F.col("v").alias("y")))


def block_pairs(d: DataFrame, dem: DataFrame, scenes: DataFrame) -> DataFrame:
    """Both grids as means over elevation-model cells: ``scene, row, col, x, y``."""
    return block_means(_pairs(d, dem), ["x", "y"], scenes.select("scene", block_size().alias("block")))


def affine_params(d: DataFrame, dem: DataFrame, scenes: DataFrame, delta: float = 2.0) -> DataFrame:
    """Method A fit per scene; a scene without usable spread gets the median of its whole DEM."""
    fit = huber_affine(block_pairs(d, dem, scenes), "x", "y", ["scene"], delta)
    fit = cut(fit)
    flat = scenes.select("scene").join(fit.where("a <> 0"), "scene", "left_anti")
    if flat.isEmpty():
        return fit
    level = quantiles(dem.join(flat, "scene", "left_semi"), ["scene"], {"b": ("v", 0.5)})
    return fit.where("a <> 0").unionByName(level.select("scene", F.lit(0.0).alias("a"), "b"))


def method_a(d: DataFrame, dem: DataFrame, scenes: DataFrame, delta: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """``a*d + b`` with the robust fit on elevation-model cells."""
    fit = affine_params(d, dem, scenes, delta)
    cells = attach(d, fit).select(*KEY, (F.col("a") * F.col("v") + F.col("b")).alias("v"))
    cal = fit.join(scenes.select("scene", block_size().alias("_b")), "scene").select(
        "scene", F.lit("dem_affine").alias("method"), F.lit("medium").alias("confidence"), F.col("a").alias("scale"),
        F.col("b").alias("offset"), F.create_map(F.lit("block_px"), F.col("_b").cast("double")).alias("details"),
    )
    return cells, cal


def band_scale(d: DataFrame, dem: DataFrame, scenes: DataFrame, coarse: float = 4.0, min_cells: int = 64) -> DataFrame:
    """Regress the DEM's resolvable detail on the model's: ``scale, r, cells`` per scene.

    Both grids are averaged to elevation-model cells, gaps take the scene mean, and a Gaussian of
    ``coarse`` cells is subtracted. Too few cells or no variation give zeros.
    """
    blocks = cut(block_pairs(d, dem, scenes))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    mean = blocks.where(ok).groupBy("scene").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    full = attach(blocks.withColumn("_ok", ok), mean).select(
        *KEY, "_ok", F.when(F.col("_ok"), F.col("x")).otherwise(F.col("_mx")).alias("x"),
        F.when(F.col("_ok"), F.col("y")).otherwise(F.col("_my")).alias("y"),
    )
    smooth_x = gaussian(full.select(*KEY, F.col("x").alias("v")), coarse).withColumnRenamed("v", "_sx")
    smooth_y = gaussian(full.select(*KEY, F.col("y").alias("v")), coarse).withColumnRenamed("v", "_sy")
    detail = meet(meet(full.where("_ok"), smooth_x), smooth_y).select(
        "scene", (F.col("x") - F.col("_sx")).alias("p"), (F.col("y") - F.col("_sy")).alias("q")
    )
    g = detail.groupBy("scene").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.col("p") * F.col("q")).alias("_pq"), F.sum(F.col("p") * F.col("p")).alias("_pp"),
        pearson("p", "q").alias("r"), (F.stddev_pop("p") > 0).alias("_vp"), (F.stddev_pop("q") > 0).alias("_vq"),
    )
    usable = (F.col("cells") >= min_cells) & F.col("_vp") & F.col("_vq")
    out = scenes.select("scene").join(g, "scene", "left")
    return out.select(
        "scene", F.when(usable, F.try_divide(F.col("_pq"), F.col("_pp"))).otherwise(0.0).alias("scale"),
        F.when(usable, F.col("r")).otherwise(0.0).alias("r"), F.coalesce("cells", F.lit(0)).cast("bigint").alias("cells"),
    )


def control_point_scale(d_high: DataFrame, dem: DataFrame, gcps: DataFrame, min_points: int = 3) -> DataFrame:
    """Scale through the origin from heights above the DEM at control points.

    Only scenes with enough listed and enough usable points and some detail appear.
    """
    at_dem = sample_points(dem, gcps).withColumnRenamed("value", "_dem")
    both = sample_points(d_high, at_dem).withColumnRenamed("value", "_f")
    target = F.col("height") - F.col("_dem")
    ok = target.isNotNull() & F.col("_f").isNotNull()
    g = both.groupBy("scene").agg(
        F.count(F.lit(1)).alias("_listed"), F.count_if(ok).alias("gcps_used"),
        F.sum(F.when(ok, F.col("_f") * target)).alias("_ft"), F.sum(F.when(ok, F.col("_f") * F.col("_f"))).alias("_ff"),
    )
    enough = (F.col("_listed") >= min_points) & (F.col("gcps_used") >= min_points) & (F.col("_ff") > 0)
    return g.where(enough).select("scene", F.try_divide(F.col("_ft"), F.col("_ff")).alias("scale"), "gcps_used")


def prior_scale(d_high: DataFrame, p: float = 98.0, height_m: float = 0.0) -> DataFrame:
    """``height_m`` over the ``p``-th percentile of the detail; 0 for featureless scenes."""
    q = quantiles(d_high, ["scene"], {"_ref": ("v", p / 100.0)})
    usable = F.col("_ref") > FLOAT32_EPS
    return q.select("scene", F.when(usable, F.try_divide(F.lit(float(height_m)), F.col("_ref"))).otherwise(0.0).alias("scale"))


def choose_scale(
    scenes: DataFrame, band: DataFrame, relief: DataFrame, cfg: CalibrationConfig, points: DataFrame | None = None,
    slope: DataFrame | None = None, prior: DataFrame | None = None,
) -> DataFrame:
    """Scale cascade per scene: control points, DEM band, DEM relief, prior, DEM only.

    All inputs have one row per scene: ``band`` (scale, r, cells), ``relief`` (dem_std_m), ``points``
    (scale, gcps_used), ``slope`` (a of Method A), ``prior`` (scale).
    """
    s = scenes.select("scene", (cfg.band_sigma_k * F.col("dem_res_m") / F.col("pixel_m")).alias("sigma_px"))
    s = s.join(band.select("scene", F.col("scale").alias("_band"), F.col("r").alias("band_r"), F.col("cells").alias("band_cells")), "scene", "left")
    s = s.join(relief.select("scene", "dem_std_m"), "scene", "left")
    null = F.lit(None).cast("double")
    s = s.join(points.select("scene", F.col("scale").alias("_gcp"), F.col("gcps_used")), "scene", "left") if points is not None else s.withColumn("_gcp", null).withColumn("gcps_used", null)
    s = s.join(slope.select("scene", F.col("a").alias("_slope")), "scene", "left") if slope is not None else s.withColumn("_slope", null)
    s = s.join(prior.select("scene", F.col("scale").alias("_prior")), "scene", "left") if prior is not None else s.withColumn("_prior", F.lit(0.0))
    by_gcp = F.col("_gcp").isNotNull()
    by_band = (F.col("band_r") >= cfg.band_min_r) & (F.col("_band") > 0)
    by_relief = (F.col("dem_std_m") > cfg.dem_relief_std_m) & (F.col("_slope") > 0)
    prior_col = F.coalesce("_prior", F.lit(0.0))
    return s.select(
        "scene",
        F.when(by_gcp, "gcp").when(by_band, "dem_band").when(by_relief, "dem_relief").when(prior_col > 0, "scene_prior").otherwise("dem_only").alias("method"),
        F.when(by_gcp, "high").when(by_band | by_relief, "medium").otherwise("low").alias("confidence"),
        F.when(by_gcp, F.col("_gcp")).when(by_band, F.col("_band")).when(by_relief, F.col("_slope")).otherwise(prior_col).alias("scale"),
        null.alias("offset"),
        F.map_filter(
            F.create_map(*[x for n in ("sigma_px", "band_r", "band_cells", "dem_std_m", "gcps_used") for x in (F.lit(n), F.col(n).cast("double"))]),
            lambda k, v: v.isNotNull(),
        ).alias("details"),
    )


def apply_scale(dem: DataFrame, d_high: DataFrame, cal: DataFrame) -> DataFrame:
    """``dem + scale * detail`` per cell."""
    j = attach(meet(dem.select(*KEY, F.col("v").alias("_dem")), d_high.select(*KEY, F.col("v").alias("_d"))), cal.select("scene", "scale"))
    return j.select(*KEY, (F.col("_dem") + F.col("scale") * F.col("_d")).alias("v"))


def method_b(
    d: DataFrame, dem: DataFrame, scenes: DataFrame, cfg: CalibrationConfig = CalibrationConfig(), gcps: DataFrame | None = None,
    d_high: DataFrame | None = None, band: DataFrame | None = None, sigma: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """DEM plus scaled model detail; the scale is the first usable source of the cascade.

    Sources that the configuration switches off are not computed. ``scenes``: scene, h, w, pixel_m,
    dem_res_m. ``sigma`` may be given when all scenes share it.
    """
    if d_high is None:
        d_high = band_split(d, scenes, cfg.band_sigma_k, sigma).select(*KEY, F.col("high").alias("v"))
        if gcps is not None or cfg.prior_height_m > 0:
            d_high = cut(d_high)  # sampled for the scale, then used again for the surface
    band = band if band is not None else band_scale(d, dem, scenes, cfg.band_coarse_cells, cfg.band_min_cells)
    relief = dem.groupBy("scene").agg(F.stddev_pop("v").alias("dem_std_m"))
    points = control_point_scale(d_high, dem, gcps, cfg.gcp_min_points) if gcps is not None else None
    slope = affine_params(d, dem, scenes, cfg.huber_delta_m) if cfg.dem_relief_std_m < RELIEF_OFF else None
    prior = prior_scale(d_high, cfg.prior_percentile, cfg.prior_height_m) if cfg.prior_height_m > 0 else None
    # one stored row per scene: the cell pass below then knows its true size
    cal = cut(choose_scale(scenes, band, relief, cfg, points, slope, prior))
    return apply_scale(dem, d_high, cal), cal


def to_geoid(dem: DataFrame, undulation: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ellipsoidal heights to geoid heights ``h - (n*scale + offset)``.

    ``scenes``: scene, source, n_scale, n_offset. A scene changes only when its source is
    ellipsoidal and the undulation covers every one of its cells; otherwise heights and datum stay.
    """
    j = meet(dem, undulation.select(*KEY, F.col("v").alias("_n")), how="left")
    gate = j.groupBy("scene").agg(F.bool_and(F.col("_n").isNotNull()).alias("_whole"))
    s = scenes.join(gate, "scene", "left")
    apply = F.col("source").isin(ELLIPSOIDAL_SOURCES) & F.coalesce("_whole", F.lit(False))
    s = s.withColumn("converted", apply).withColumn("datum", F.when(apply, CONVERTED_DATUM).otherwise(datum_of("source")))
    x = attach(j, s.select("scene", "converted", "n_scale", "n_offset"))
    v = F.when(F.col("converted"), F.col("v") - (F.col("_n") * F.col("n_scale") + F.col("n_offset"))).otherwise(F.col("v"))
    return x.select(*KEY, v.alias("v")), s.drop("_whole")
