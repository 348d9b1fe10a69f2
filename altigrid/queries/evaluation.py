"""Checked queries: roll-ups, rankings, sweeps, report tables and the flagship."""

from pyspark.sql import functions as F

from altigrid.model import meet
from altigrid.operators import evaluation as ev
from altigrid.operators import metrics
from altigrid.operators.calibration import CalibrationConfig
from altigrid.queries import fixtures as fx
from altigrid.queries.calibration import BAND, GRIDS, HIGH, inputs
from altigrid.queries.metrics import M, SCENE_PAIRS, e1_sql, r6, scene_pairs
from altigrid.queries.registry import query

S = ev.SUMMARY_METRICS
KEY = ["scene", "row", "col"]
AVG = ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}" for m in S)


@query("flagship_landscape_scores", fx.with_sql(fx.G1, fx.G2, SCENE_PAIRS, e1_sql("scene", "sp"), f"lt AS (SELECT *, {fx.LANDSCAPE} AS landscape FROM e1)") + f"""
SELECT coalesce(landscape, 'all') AS landscape, count(*) AS tiles, {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in M)} FROM lt GROUP BY GROUPING SETS ((landscape), ())""")
def flagship(spark, d):
    tiles = metrics.dsm_metrics(scene_pairs(spark, d), "pred", "ref", ["scene"])
    rows = tiles.withColumn("landscape", fx.landscape(F.col("scene"))).withColumn("method", F.lit("model")).withColumn("ndsm_rmse", F.lit(None).cast("double"))
    return r6(ev.summarize(rows).drop("method", "ndsm_rmse"), M)


@query("e17_landscape_summary", fx.with_sql(fx.PER_TILE) + f"""
SELECT coalesce(landscape, 'all') AS landscape, method, count(*) AS tiles, {AVG} FROM per_tile GROUP BY GROUPING SETS ((landscape, method), (method))""")
def e17(spark, d):
    return r6(ev.summarize(fx.per_tile(spark, d)), S)


@query("e18_relative_summary", fx.with_sql(fx.PER_TILE) + f"""
SELECT count(*) AS tiles, {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in M)}, true AS scale_aligned FROM per_tile WHERE method = 'P' HAVING count(*) > 0""")
def e18(spark, d):
    return r6(ev.summarize_relative(fx.per_tile(spark, d), "P"), M)


@query("e19_balanced_objective", fx.with_sql(fx.PER_TILE) + """
SELECT method, round(avg(m), 6) + 0.0 AS objective FROM (SELECT method, landscape, avg(rmse) AS m FROM per_tile GROUP BY 1, 2) GROUP BY method""")
def e19(spark, d):
    return r6(ev.balanced_objective(fx.per_tile(spark, d), ["method"]), ["objective"])


@query("e20_source_histogram", fx.with_sql(fx.PER_TILE) + """
SELECT method, string_agg(landscape || ':' || n, ';' ORDER BY landscape) AS sources FROM (SELECT method, landscape, count(*) AS n FROM per_tile GROUP BY 1, 2) GROUP BY method""")
def e20(spark, d):
    return ev.source_histogram(fx.per_tile(spark, d), ["method"], "landscape")


@query("e24_stage_runtime", """
WITH one AS (SELECT l_orderkey, max(struct_pack(a := l_linenumber, q := l_quantity, d := l_discount, s := l_returnflag)) AS t FROM lineitem GROUP BY 1)
SELECT t.s AS scene_px, count(*) AS scenes, round(avg(t.q), 6) + 0.0 AS depth_s, round(avg(t.d), 6) + 0.0 AS calibrate_s FROM one GROUP BY GROUPING SETS ((t.s), ())""")
def e24(spark, d):
    t = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), "l_linenumber", F.col("l_quantity").alias("depth_s"), F.col("l_discount").alias("calibrate_s"), F.col("l_returnflag").alias("scene_px"))
    return r6(ev.stage_runtime(t, ["depth_s", "calibrate_s"], "l_linenumber"), ["depth_s", "calibrate_s"])


@query("e25_gain_table", fx.with_sql(fx.PER_TILE, "sm AS (SELECT coalesce(landscape, 'all') AS landscape, method, avg(rmse) AS r, avg(ndsm_rmse) AS n FROM per_tile GROUP BY GROUPING SETS ((landscape, method), (method)))",
    "wd AS (SELECT landscape, max(r) FILTER (method = 'F') AS rf, max(n) FILTER (method = 'F') AS nf, max(r) FILTER (method = 'O') AS ro, max(n) FILTER (method = 'O') AS no_, max(r) FILTER (method = 'P') AS rp, max(n) FILTER (method = 'P') AS np FROM sm GROUP BY 1)") + """
SELECT landscape, round(100 * (rf - ro) / rf, 6) + 0.0 AS gain_rmse_O, round(100 * (nf - no_) / nf, 6) + 0.0 AS gain_ndsm_rmse_O, round(100 * (rf - rp) / rf, 6) + 0.0 AS gain_rmse_P, round(100 * (nf - np) / nf, 6) + 0.0 AS gain_ndsm_rmse_P FROM wd""")
def e25(spark, d):
    out = ev.gain_table(ev.summarize(fx.per_tile(spark, d)), "F", ["O", "P"])
    return r6(out, out.columns[1:])


@query("f05_balanced_sample", """
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
k AS (SELECT *, least(n, CAST(ceil(90.0 / (SELECT count(DISTINCT p_brand) FROM part)) AS BIGINT)) AS k FROM r)
SELECT p_brand, p_partkey FROM k WHERE EXISTS (SELECT 1 FROM range(0, 90) t(j) WHERE j < k AND p = CASE WHEN k = 1 THEN 0 WHEN j = k - 1 THEN n - 1 ELSE round_even(j * ((n - 1) / CAST(k - 1 AS DOUBLE)), 0) END)
ORDER BY p_partkey LIMIT 90""")
def f05(spark, d):
    return ev.select_balanced(fx.table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 90)


@query("h01_worst_tiles", fx.with_sql(fx.PER_TILE) + "SELECT tile, landscape, round(rmse, 6) + 0.0 AS rmse FROM per_tile WHERE method = 'F' AND rmse IS NOT NULL ORDER BY rmse DESC, tile LIMIT 5")
def h01(spark, d):
    return r6(ev.worst_tiles(fx.per_tile(spark, d), "F").select("tile", "landscape", "rmse"), ["rmse"])


@query("h02_diverse_pair", fx.with_sql(fx.PER_TILE, "rk AS (SELECT tile, landscape, rmse FROM per_tile WHERE method = 'F' AND rmse IS NOT NULL)", "w AS (SELECT * FROM rk ORDER BY rmse DESC, tile LIMIT 1)") + """
SELECT landscape, tile, round(rmse, 6) + 0.0 AS rmse FROM (SELECT landscape, tile, rmse FROM w UNION ALL (SELECT landscape, tile, rmse FROM rk WHERE landscape <> (SELECT landscape FROM w) ORDER BY rmse DESC, tile LIMIT 1))""")
def h02(spark, d):
    return r6(ev.diverse_worst(fx.per_tile(spark, d), "F"), ["rmse"])


SETTINGS = [
    {"resampling": "nearest", "band_sigma_k": 1.0, "band_coarse_cells": 4.0, "band_min_r": r, "dem_relief_std_m": 1.0e9, "prior_height_m": p}
    for r in (0.1, 0.93, 2.0) for p in (0.0, 6.0, 12.0)
]
SWEEP = ",\n".join([
    HIGH, BAND, "pri AS (SELECT scene, quantile_cont(v, 0.98) AS q FROM hi GROUP BY scene)", fx.G2, fx.G3,
    "st AS (SELECT CAST(i * 3 + j AS INTEGER) AS setting, [0.1, 0.93, 2.0][i + 1]::DOUBLE AS min_r, [0.0, 6.0, 12.0][j + 1]::DOUBLE AS ph FROM range(0, 3) a(i), range(0, 3) b(j))",
    """cs AS (SELECT scene, setting, min_r, ph, CASE WHEN r >= min_r AND scale > 0 THEN 'dem_band' WHEN ph > 0 THEN 'scene_prior' ELSE 'dem_only' END AS source,
    CASE WHEN r >= min_r AND scale > 0 THEN scale ELSE ph / q END AS s FROM band JOIN pri USING (scene), st)""",
    """sw AS (SELECT setting, min_r, ph, scene, row // 25 * 10 + col // 32 AS tile, any_value(source) AS source, any_value(s) AS scale,
    sqrt(avg(pow(dem.v + s * hi.v - g2.v, 2))) AS rmse, sqrt(avg(pow(dem.v + s * hi.v - g2.v, 2)) FILTER (g2.v - g3.v > 2.5)) AS rmse_objects, sqrt(avg(pow(dem.v - g2.v, 2))) AS base
  FROM dem JOIN hi USING (scene, row, col) JOIN g2 USING (scene, row, col) JOIN g3 USING (scene, row, col) JOIN cs USING (scene) WHERE g2.v IS NOT NULL GROUP BY 1, 2, 3, 4, 5)""",
])


def sweep_scores(spark, d):
    from altigrid.functions.terrain import object_mask

    x, dem, sc = inputs(spark, d)
    cells = fx.g1(spark, d)
    both = meet(fx.g2(cells).withColumnRenamed("v", "ref"), fx.g3(cells).withColumnRenamed("v", "dtm"))
    tile = (F.floor(F.col("row") / 25) * 10 + F.floor(F.col("col") / 32)).cast("int")
    truth = both.select(*KEY, tile.alias("tile"), "ref", object_mask("ref", "dtm").alias("is_object"))
    return ev.sweep(x, {"nearest": dem}, truth, sc, SETTINGS, CalibrationConfig(), {1.0: 4.0})


@query("h03_parameter_sweep", fx.with_sql(*GRIDS, SWEEP) + """
SELECT setting, scene, CAST(tile AS INTEGER) AS tile, source, round(scale, 4) + 0.0 AS scale, round(rmse, 4) + 0.0 AS rmse, round(rmse_objects, 4) + 0.0 AS rmse_objects FROM sw""")
def h03(spark, d):
    s = sweep_scores(spark, d)
    return r6(s.select("setting", "scene", "tile", "source", "scale", "rmse", "rmse_objects"), ["scale", "rmse", "rmse_objects"], 4)


@query("h04_sweep_ranking", fx.with_sql(*GRIDS, SWEEP, f"""tb AS (SELECT setting, min_r, ph, avg(m) AS objective, avg(o) AS nd FROM (
    SELECT setting, min_r, ph, {fx.LANDSCAPE} AS landscape, avg(rmse) AS m, avg(rmse_objects) AS o FROM sw GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""",
    "so AS (SELECT setting, string_agg(source || ':' || n, ';' ORDER BY source) AS sources FROM (SELECT setting, source, count(*) AS n FROM cs GROUP BY 1, 2) GROUP BY 1)",
    "rk AS (SELECT *, row_number() OVER (ORDER BY round(objective, 9), setting) AS rank FROM tb JOIN so USING (setting))") + f"""
SELECT 'ranked' AS kind, CAST(rank AS INTEGER) AS rank, setting, round(objective, 4) + 0.0 AS objective, round(nd, 4) + 0.0 AS ndsm_objective, sources FROM rk WHERE rank <= 5
UNION ALL SELECT 'current', CAST(rank AS INTEGER), setting, round(objective, 4) + 0.0, round(nd, 4) + 0.0, sources FROM rk WHERE min_r = 0.1 AND ph = 0
UNION ALL SELECT 'dem_only', NULL, NULL, (SELECT round(avg(m), 4) + 0.0 FROM (SELECT {fx.LANDSCAPE} AS landscape, avg(base) AS m FROM sw WHERE setting = 0 GROUP BY 1)), NULL, NULL""")
def h04(spark, d):
    out = ev.rank_sweep(sweep_scores(spark, d), {"band_min_r": 0.1, "prior_height_m": 0.0}, 5)
    return r6(out.select("kind", "rank", "setting", "objective", "ndsm_objective", "sources"), ["objective", "ndsm_objective"], 4)


def stacked(spark, d):
    cells = fx.g1(spark, d)
    wide = cells.select(*KEY, (F.col("v") - 1.5).alias("dem"), (F.col("v") * 1.1).alias("method_a"), F.col("v").alias("method_b"))
    s = cells.select("scene").distinct()
    a = s.select("scene", (F.col("scene") * 2.0).alias("scale"))
    b = s.select("scene", F.when(F.col("scene") % 2 == 0, "dem_band").otherwise("gcp").alias("method"), (F.col("scene") + 0.5).alias("scale"))
    return wide, a, b


H5 = """mt AS (SELECT scene, row, col, 'dem_only' AS method, v - 1.5::DOUBLE AS pred, '' AS cal_source, NULL::DOUBLE AS scale FROM g1
  UNION ALL SELECT scene, row, col, 'method_a', v * 1.1::DOUBLE, 'dem_affine', scene * 2.0::DOUBLE FROM g1
  UNION ALL SELECT scene, row, col, 'method_b', v, CASE WHEN scene % 2 = 0 THEN 'dem_band' ELSE 'gcp' END, scene + 0.5::DOUBLE FROM g1)"""


@query("h05_method_union", fx.with_sql(fx.G1, H5) + "SELECT scene, row, col, method, round(pred, 6) + 0.0 AS pred, cal_source, scale FROM mt")
def h05(spark, d):
    return r6(ev.stack_methods(*stacked(spark, d)), ["pred"])


LABELS = {"F": "Finished", "O": "Open", "P": "Pending"}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "all"]


@query("h06_report_table", fx.with_sql(fx.PER_TILE, f"sm AS (SELECT coalesce(landscape, 'all') AS landscape, method, count(*) AS tiles, {', '.join(f'avg({m}) AS {m}' for m in S)} FROM per_tile GROUP BY GROUPING SETS ((landscape, method), (method)))") + f"""
SELECT CAST((list_position({PRIORITIES}, landscape) - 1) * 3 + list_position(['F', 'O', 'P'], method) AS INTEGER) AS position, landscape,
  CASE method WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Pending' END AS label, tiles,
  {', '.join(f"coalesce(printf('%.{3 if m == 'pearson_r' else 2}f', {m}), '–') AS {m}" for m in S)} FROM sm WHERE list_position({PRIORITIES}, landscape) > 0""")
def h06(spark, d):
    return ev.report_table(ev.summarize(fx.per_tile(spark, d)), PRIORITIES, LABELS)


