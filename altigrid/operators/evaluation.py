"""Roll-ups, rankings, sweeps and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.functions.labels import LANDSCAPE_ORDER, METHOD_LABELS, fmt, method_label, order_of
from altigrid.model import KEY, attach, cut, meet
from altigrid.operators.blur import band_split
from altigrid.operators.calibration import CalibrationConfig, RELIEF_OFF, affine_params, band_scale
from altigrid.operators.joins import last_per
from altigrid.operators.metrics import METRICS, dsm_metrics
from altigrid.operators.ranks import quantiles

SUMMARY_METRICS = [*METRICS, "ndsm_rmse"]
FLOAT32_EPS = 1.1920928955078125e-07
RANK_DIGITS = 9


def summarize(per_tile: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Means of per-tile values by landscape and method, and over ``all`` landscapes.

    Missing values are skipped by the means but their tiles still count.
    """
    rows = per_tile.where(F.col("method").isin(methods)) if methods else per_tile
    rows = rows.select("landscape", "method", *SUMMARY_METRICS)
    g = rows.groupingSets([[F.col("landscape"), F.col("method")], [F.col("method")]], F.col("landscape"), F.col("method")).agg(
        F.grouping("landscape").alias("_all"), F.count(F.lit(1)).alias("tiles"), *[F.avg(m).alias(m) for m in SUMMARY_METRICS]
    )
    return g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("landscape")).alias("landscape"), "method", "tiles", *SUMMARY_METRICS)


def summarize_relative(per_tile: DataFrame, method: str = "relative") -> DataFrame:
    """Means over the relative-mode tiles; no row when there are none."""
    g = per_tile.where(F.col("method") == method).agg(F.count(F.lit(1)).alias("tiles"), *[F.avg(m).alias(m) for m in METRICS])
    return g.where("tiles > 0").withColumn("scale_aligned", F.lit(True))


def balanced_objective(df: DataFrame, by: list[str], value: str = "rmse") -> DataFrame:
    """Mean over landscapes of the mean per-tile value; landscapes without values are left out."""
    per = df.groupBy(*by, "landscape").agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("objective"))


def source_histogram(df: DataFrame, by: list[str], source: str = "source") -> DataFrame:
    """``name:count;...`` sorted by name. Scale sources are a short fixed list of names."""
    n = df.where(F.col(source).isNotNull()).groupBy(*by, source).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col(source).alias("k"), F.concat_ws(":", F.col(source), F.col("_n").cast("string")).alias("t"))
    return n.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["t"]), ";").alias("sources"))


def stage_runtime(per_tile: DataFrame, stages: list[str], order: Column | str, size: str = "scene_px") -> DataFrame:
    """One timing row per scene (its last), then per scene size the scene count and the mean of each
    stage, and a row over all of them with a NULL size."""
    one = last_per(per_tile.where(F.col("scene").isNotNull()), ["scene"], order, [*stages, size])
    means = [F.count(F.lit(1)).alias("scenes"), *[F.avg(s).alias(s) for s in stages]]
    return one.where(F.col(size).isNotNull()).groupBy(size).agg(*means).unionByName(one.agg(*means).withColumn(size, F.lit(None).cast(one.schema[size].dataType)))


def gain_table(summary: DataFrame, base: str, methods: list[str], metrics: tuple[str, ...] = ("rmse", "ndsm_rmse")) -> DataFrame:
    """Percentage gain over the base method per landscape and metric, wide by method."""
    wide = summary.groupBy("landscape").pivot("method", [base, *methods]).agg(*[F.first(m).alias(m) for m in metrics])
    gain = [
        F.try_divide(100.0 * (F.col(f"`{base}_{m}`") - F.col(f"`{x}_{m}`")), F.col(f"`{base}_{m}`")).alias(f"gain_{m}_{x}")
        for x in methods for m in metrics
    ]
    return wide.select("landscape", *gain)


def select_balanced(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """evenly spaced picks per group, groups equally represented, then sorted and capped.

    Positions come from a range partitioning with per-partition offsets, so a group that holds most
    of the rows is not sorted in one task.
    """
    groups = df.select(group).distinct().count()
    if not groups:
        return df
    per_group = math.ceil(limit / groups)
    parts = cut(df.repartitionByRange(group, order).withColumn("_pid", F.spark_partition_id()))
    sizes = parts.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    g = Window.partitionBy(group)
    sizes = sizes.select(
        group, "_pid", (F.sum("_c").over(g.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(g).alias("_n"),
    )
    rank = F.row_number().over(Window.partitionBy(group, "_pid").orderBy(order))
    x = parts.withColumn("_rn", rank).join(sizes, [group, "_pid"]).withColumn("_p", F.col("_off") + F.col("_rn") - 1)
    last = (F.col("_n") - 1).cast("double")
    k = F.least(F.lit(per_group), F.col("_n"))
    step = F.coalesce(F.try_divide(last, k - 1), F.lit(0.0))
    near = F.floor(F.coalesce(F.try_divide(F.col("_p").cast("double"), step), F.lit(0.0)))
    tries = F.transform(F.array(*[near + i for i in (-1, 0, 1, 2)]), lambda j: F.least(F.greatest(j, F.lit(0)), k - 1))
    hit = F.exists(tries, lambda j: F.when(j == k - 1, F.when(k > 1, last).otherwise(0.0)).otherwise(F.rint(j * step)) == F.col("_p"))
    return x.where(hit).select(*df.columns).orderBy(order).limit(limit)


def worst_tiles(per_tile: DataFrame, method: str, n: int = 5) -> DataFrame:
    """H1: the ``n`` tiles of a method with the largest RMSE; missing values are left out."""
    rows = per_tile.where((F.col("method") == method) & F.col("rmse").isNotNull())
    return rows.orderBy(F.desc("rmse"), F.asc("tile")).limit(n)


def diverse_worst(per_tile: DataFrame, method: str) -> DataFrame:
    """H2: the worst tile and the worst one of any other landscape.

    The worst tile per landscape is a combinable aggregate; the two worst of those are the pair.
    """
    rows = per_tile.where((F.col("method") == method) & F.col("rmse").isNotNull())
    first = F.min(F.struct((-F.col("rmse")).alias("_o"), "tile", "rmse")).alias("_t")  # equal values: the smallest tile, as in H1
    top = rows.groupBy("landscape").agg(first).select("landscape", "_t.tile", "_t.rmse")
    return top.orderBy(F.desc("rmse"), F.asc("tile")).limit(2)


def stack_methods(cells: DataFrame, cal_a: DataFrame, cal_b: DataFrame) -> DataFrame:
    """H5: one row per cell and method from ``scene, row, col, ..., dem, method_a, method_b``.

    The scale and its source belong to the method: none for the DEM, the fit for A, the cascade's
    choice for B. One pass over the wide cells; nothing is joined three times.
    """
    a = cal_a.select("scene", F.col("scale").alias("_sa"))
    b = cal_b.select("scene", F.col("method").alias("_mb"), F.col("scale").alias("_sb"))
    x = attach(cells, a.join(b, "scene"))
    null = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("dem_only").alias("method"), F.col("dem").alias("pred"), F.lit("").alias("cal_source"), null.alias("scale")),
        F.struct(F.lit("method_a").alias("method"), F.col("method_a").alias("pred"), F.lit("dem_affine").alias("cal_source"), F.col("_sa").alias("scale")),
        F.struct(F.lit("method_b").alias("method"), F.col("method_b").alias("pred"), F.col("_mb").alias("cal_source"), F.col("_sb").alias("scale")),
    )
    keep = [c for c in cells.columns if c not in ("dem", "method_a", "method_b")]
    return x.select(*keep, F.explode(rows).alias("_m")).select(*keep, "_m.*")


def score_tiles(stacked: DataFrame, by: list[str], objects: str = "is_object") -> DataFrame:
    """Per-tile metrics on all cells plus RMSE and count on objects."""
    keys = [*by, "method", "cal_source", "scale"]
    rows = stacked.withColumn("scale", F.coalesce("scale", F.lit(float("-inf"))))  # join key: never NULL
    full = dsm_metrics(rows, "pred", "ref", keys)
    e = F.when(F.col(objects), F.col("pred") - F.col("ref"))
    obj = rows.groupBy(*keys).agg(F.count(e).alias("ndsm_pixels"), F.sqrt(F.avg(e * e)).alias("_o"))
    obj = obj.withColumn("ndsm_rmse", F.when(F.col("ndsm_pixels") >= 2, F.col("_o"))).drop("_o")
    out = full.join(obj, keys)
    return out.withColumn("scale", F.when(F.col("scale") > float("-inf"), F.col("scale")))


def report_table(summary: DataFrame, landscapes: list[str] | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """H6: summary rows in display order with fixed digits; unknown landscapes are not shown."""
    landscapes, labels = landscapes or LANDSCAPE_ORDER, labels or METHOD_LABELS
    names = list(labels)
    pick = method_label("method") if labels is METHOD_LABELS else F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("method"))
    rows = summary.withColumn("_l", order_of("landscape", landscapes)).withColumn("_m", order_of("method", names))
    rows = rows.where(F.col("_l").isNotNull() & F.col("_m").isNotNull())
    digits = {"pearson_r": 3}
    return rows.select(
        ((F.col("_l") - 1) * len(names) + F.col("_m")).alias("position"), "landscape", pick.alias("label"), "tiles",
        *[fmt(m, digits.get(m, 2)).alias(m) for m in SUMMARY_METRICS],
    ).orderBy("position")


def sweep(
    d: DataFrame, dems: dict[str, DataFrame], truth: DataFrame, scenes: DataFrame, settings: list[dict],
    cfg: CalibrationConfig = CalibrationConfig(), sigma_of: dict[float, float] | None = None,
) -> DataFrame:
    """H3: every setting scored per tile on all cells and on objects.

    ``truth``: scene, row, col, tile, ref, is_object. ``settings``: dicts with ``resampling``,
    ``band_sigma_k``, ``band_coarse_cells``, ``band_min_r``, ``dem_relief_std_m``,
    ``prior_height_m``. A setting only changes the scale ``s`` of ``dem + s*detail``, and the squared
    error is ``A + 2sB + s^2C`` with three sums per tile. So the cells are read once per resampling
    and band width, and all settings are scored on those sums: cells are never multiplied by the
    number of settings.
    """
    modes = sorted({s["resampling"] for s in settings})
    widths = sorted({float(s["band_sigma_k"]) for s in settings})
    coarse = sorted({float(s["band_coarse_cells"]) for s in settings})
    want_slope = any(s["dem_relief_std_m"] < RELIEF_OFF for s in settings)
    want_prior = any(s["prior_height_m"] > 0 for s in settings)
    stats, bands, reliefs, slopes, priors = [], [], [], [], []
    for k in widths:
        high = band_split(d, scenes, k, (sigma_of or {}).get(k)).select(*KEY, F.col("high"))
        if want_prior or len(modes) > 1:
            high = cut(high)  # read once per resampling and once for the percentile
        if want_prior:
            priors.append(quantiles(high, ["scene"], {"_ref": ("high", cfg.prior_percentile / 100.0)}).withColumn("k", F.lit(k)))
        for mode in modes:
            x = meet(meet(dems[mode].select(*KEY, F.col("v").alias("dem")), high), truth)
            e = F.col("dem") - F.col("ref")
            both = e * F.col("high")
            ok = both.isNotNull()
            obj = ok & F.col("is_object")
            sums = []
            for p, cond in (("", ok), ("o", obj)):
                sums += [F.count_if(cond).alias(f"n{p}"), F.sum(F.when(cond, e * e)).alias(f"a{p}"),
                         F.sum(F.when(cond, both)).alias(f"b{p}"), F.sum(F.when(cond, F.col("high") * F.col("high"))).alias(f"c{p}")]
            stats.append(x.groupBy("scene", "tile").agg(*sums).withColumn("mode", F.lit(mode)).withColumn("k", F.lit(k)))
    for mode in modes:
        for c in coarse:
            bands.append(band_scale(d, dems[mode], scenes, c, cfg.band_min_cells).withColumn("mode", F.lit(mode)).withColumn("coarse", F.lit(c)))
        reliefs.append(dems[mode].groupBy("scene").agg(F.stddev_pop("v").alias("std")).withColumn("mode", F.lit(mode)))
        if want_slope:
            slopes.append(affine_params(d, dems[mode], scenes, cfg.huber_delta_m).select("scene", F.col("a").alias("slope")).withColumn("mode", F.lit(mode)))

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    listed = F.array(*[
        F.struct(
            F.lit(i).alias("setting"), F.lit(s["resampling"]).alias("mode"), F.lit(float(s["band_sigma_k"])).alias("k"),
            F.lit(float(s["band_coarse_cells"])).alias("coarse"), F.lit(float(s["band_min_r"])).alias("min_r"),
            F.lit(float(s["dem_relief_std_m"])).alias("relief_limit"), F.lit(float(s["prior_height_m"])).alias("prior_h"),
        ) for i, s in enumerate(settings)
    ])
    choice = scenes.select("scene", "landscape", F.explode(listed).alias("_s")).select("scene", "landscape", "_s.*")
    choice = choice.join(union(bands), ["scene", "mode", "coarse"]).join(union(reliefs), ["scene", "mode"])
    choice = choice.join(union(slopes), ["scene", "mode"], "left") if want_slope else choice.withColumn("slope", F.lit(0.0))
    choice = choice.join(union(priors), ["scene", "k"], "left") if want_prior else choice.withColumn("_ref", F.lit(0.0))
    by_band = (F.col("r") >= F.col("min_r")) & (F.col("scale") > 0)
    by_relief = (F.col("std") > F.col("relief_limit")) & (F.col("slope") > 0)
    prior = F.when(F.col("_ref") > FLOAT32_EPS, F.try_divide(F.col("prior_h"), F.col("_ref"))).otherwise(0.0)
    choice = choice.withColumn("source", F.when(by_band, "dem_band").when(by_relief, "dem_relief").when(prior > 0, "scene_prior").otherwise("dem_only"))
    choice = choice.withColumn("s", F.when(by_band, F.col("scale")).when(by_relief, F.col("slope")).otherwise(prior))
    s = F.col("s")

    def rmse(p: str) -> Column:
        total = F.col(f"a{p}") + 2.0 * s * F.col(f"b{p}") + s * s * F.col(f"c{p}")
        return F.sqrt(F.greatest(F.try_divide(total, F.col(f"n{p}")), F.lit(0.0)))

    scored = union(stats).join(choice, ["scene", "mode", "k"])
    no_objects = F.col("no") == 0
    return scored.select(
        "setting", "mode", F.col("k").alias("band_sigma_k"), F.col("coarse").alias("band_coarse_cells"), F.col("min_r").alias("band_min_r"),
        F.col("relief_limit").alias("dem_relief_std_m"), F.col("prior_h").alias("prior_height_m"), "scene", "tile", "landscape", "source",
        F.col("s").alias("scale"), F.when(F.col("n") > 0, rmse("")).alias("rmse"), F.when(~no_objects, rmse("o")).alias("rmse_objects"),
        F.when(F.col("n") > 0, F.sqrt(F.col("a") / F.col("n"))).alias("rmse_dem_only"),
    )


def rank_sweep(scores: DataFrame, current: dict, top: int = 10) -> DataFrame:
    """H4: settings by objective with the best ones, the current default and the DEM-only rows.

    ``kind`` is ``ranked`` (rank 1 is the best), ``current`` or ``dem_only``. The number of settings
    is the length of the caller's list, so ranking them is small. Settings that choose the same scales have one
    objective, whose last bits depend on the order of its sums: objectives are ranked to ``RANK_DIGITS`` digits,
    equal ones by ``setting``.
    """
    keys = ["mode", "band_sigma_k", "band_coarse_cells", "band_min_r", "dem_relief_std_m", "prior_height_m"]
    by = ["setting", *keys]
    scores = cut(scores)  # read four times below
    obj = balanced_objective(scores, by)
    nd = balanced_objective(scores, by, "rmse_objects").withColumnRenamed("objective", "ndsm_objective").select("setting", "ndsm_objective")
    # one source per scene and setting
    sources = source_histogram(scores.select("setting", "scene", "source").distinct(), ["setting"])
    table = obj.join(nd, "setting").join(sources, "setting")
    ranked = table.withColumn("rank", F.row_number().over(Window.orderBy(F.round("objective", RANK_DIGITS).asc_nulls_last(), "setting")))
    is_current = F.lit(True)
    for k, v in current.items():
        is_current = is_current & (F.col(k) == F.lit(v))
    best = ranked.where(F.col("rank") <= top).withColumn("kind", F.lit("ranked"))
    now = ranked.where(is_current).withColumn("kind", F.lit("current"))
    base = scores.select("mode", "scene", "tile", "landscape", F.col("rmse_dem_only").alias("rmse")).distinct()
    base = balanced_objective(base, ["mode"]).withColumn("kind", F.lit("dem_only"))
    return best.unionByName(now).unionByName(base, allowMissingColumns=True)
