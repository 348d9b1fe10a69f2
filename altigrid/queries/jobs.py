"""Checked queries: the composite jobs V1-V4."""

from pyspark.sql import functions as F

from altigrid.operators import evaluation as ev
from altigrid.operators import joins
from altigrid.plans import jobs
from altigrid.queries import fixtures as fx
from altigrid.queries.calibration import HIGH
from altigrid.queries.evaluation import H5, stacked
from altigrid.queries.joins import ITEMS
from altigrid.queries.metrics import M, e1_sql, r6, sql_r
from altigrid.queries.registry import query
from altigrid.queries.scalars import SITES
from altigrid.queries.terrain import bilin_sql, blur_sql

KEY = ["scene", "row", "col"]

# V1: the coarse DEM in two overlapping parts, bilinear onto the image grid; on every fifth scene it is all nodata
V1_CTES = [
    fx.G1, fx.G2_FULL, fx.G4,
    "g4s AS (SELECT * FROM g4 WHERE scene % 5 <> 4)",
    "tg AS (SELECT scene, row, col, (row + 0.5::DOUBLE) / 5 - 0.5::DOUBLE AS y, (col + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS x FROM g1)",
    bilin_sql("g4s", "tg", "y", "x", "dm0", "q.scene, q.row, q.col"),
    "dem AS (SELECT scene, row, col, value AS v FROM dm0 WHERE scene % 5 <> 4)", HIGH,
    """bp AS (SELECT scene, row // 4 AS row, col // 4 AS col, CASE WHEN count(g1.v) = 16 THEN avg(g1.v) END AS x, CASE WHEN count(dem.v) = 16 THEN avg(dem.v) END AS y
  FROM g1 JOIN dem USING (scene, row, col) GROUP BY 1, 2, 3 HAVING count(*) = 16)""",
    "bm AS (SELECT scene, avg(x) AS mx, avg(y) AS my FROM bp WHERE x + y IS NOT NULL GROUP BY scene)",
    "bx AS (SELECT scene, row, col, CASE WHEN x + y IS NOT NULL THEN x ELSE mx END AS v FROM bp JOIN bm USING (scene))",
    "by_ AS (SELECT scene, row, col, CASE WHEN x + y IS NOT NULL THEN y ELSE my END AS v FROM bp JOIN bm USING (scene))",
    blur_sql("bx", 4.0, "sx"), blur_sql("by_", 4.0, "sy"),
    "dt AS (SELECT scene, bp.x - sx.v AS p, bp.y - sy.v AS q FROM bp JOIN sx USING (scene, row, col) JOIN sy USING (scene, row, col) WHERE bp.x + bp.y IS NOT NULL)",
    "band AS (SELECT scene, sum(p * q) / sum(p * p) AS scale, corr(p, q) AS r, count(*) AS cells FROM dt GROUP BY scene)",
    "cs AS (SELECT scene, CASE WHEN r >= 0.1 AND scale > 0 AND cells >= 64 THEN scale ELSE 0 END AS s, CASE WHEN r >= 0.1 AND scale > 0 AND cells >= 64 THEN 'dem_band' ELSE 'dem_only' END AS method FROM band)",
    "rel AS (SELECT scene, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi_ FROM g1 WHERE scene % 5 = 4 GROUP BY scene)",
]


def calibrated(spark, d):
    cells = fx.g1(spark, d)
    sc = fx.scenes(cells).withColumn("source", F.lit("srtm"))
    coarse = fx.g4(cells).withColumn("v", F.when(F.col("scene") % 5 != 4, F.col("v")))
    # part 1 lacks a strip of rows, part 2 has everything but loses where part 1 is present
    one = coarse.select(*KEY, F.when(F.col("row") != 3, F.col("v")).alias("v"), F.lit("p1").alias("layer"), F.lit(1).alias("priority"))
    two = coarse.select(*KEY, F.when(F.col("row") == 3, F.col("v")).alias("v"), F.lit("p2").alias("layer"), F.lit(2).alias("priority"))

    def affine(a, e):
        return F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), F.lit(e).alias("e"), F.lit(0.0).alias("f"))

    target = sc.select("scene", "h", "w", affine(4.0, -5.0).alias("src"), affine(1.0, -1.0).alias("dst"))
    return jobs.calibrate(cells, sc, one.unionByName(two), target, sigma=4.0)


@query("v1_calibrate", fx.with_sql(*V1_CTES) + """
SELECT scene, row, col, 'absolute' AS mode, round(dem.v + s * hi.v, 4) + 0.0 AS v FROM dem JOIN hi USING (scene, row, col) JOIN cs USING (scene)
UNION ALL SELECT scene, row, col, 'relative', round(least(greatest((v - lo) / greatest(hi_ - lo, 1.1920928955078125e-07), 0), 1), 4) + 0.0 FROM g1 JOIN rel USING (scene)""")
def v1(spark, d):
    return r6(calibrated(spark, d)[0], ["v"], 4)


@query("v1_calibrate_records", fx.with_sql(*V1_CTES) + """
SELECT scene, 'absolute' AS mode, method, CASE method WHEN 'dem_band' THEN 'medium' ELSE 'low' END AS confidence, round(s, 6) + 0.0 AS scale, 'EGM96' AS datum FROM cs
UNION ALL SELECT scene, 'relative', 'none', 'n/a', NULL, NULL FROM rel""")
def v1_records(spark, d):
    return r6(calibrated(spark, d)[1].select("scene", "mode", "method", "confidence", "scale", "datum"), ["scale"])


V2_CTES = [
    fx.G1, fx.G2, fx.G3, H5,
    """rf AS (SELECT scene, row, col, CASE WHEN NOT (scene % 4 = 1 AND row >= 25 AND col >= 32) THEN v END AS v FROM g2),
pr AS (SELECT mt.scene, mt.method, mt.pred AS p, rf.v AS r, rf.v - g3.v > 2.5 AS obj, mt.row // 25 * 10 + mt.col // 32 AS tile FROM mt JOIN rf USING (scene, row, col) JOIN g3 USING (scene, row, col)),
ky AS (SELECT scene * 1000 + tile * 10 + CASE method WHEN 'dem_only' THEN 0 WHEN 'method_a' THEN 1 ELSE 2 END AS k, p, r FROM pr)""",
    e1_sql("k", "ky"),
    """od AS (SELECT scene, tile, method, scene * 1000 + tile * 10 + CASE method WHEN 'dem_only' THEN 0 WHEN 'method_a' THEN 1 ELSE 2 END AS k, sqrt(avg(pow(p - r, 2)) FILTER (obj)) AS o, count(*) FILTER (obj) AS ndsm_pixels FROM pr GROUP BY 1, 2, 3)""",
    f"pt AS (SELECT e1.*, od.scene, od.tile, od.method, CASE WHEN ndsm_pixels >= 2 THEN o END AS ndsm_rmse, ndsm_pixels, {fx.LANDSCAPE.replace('scene', 'od.scene')} AS landscape FROM e1 JOIN od USING (k))",
]


def evaluated(spark, d):
    wide, a, b = stacked(spark, d)
    cells = fx.g1(spark, d)
    sc = fx.scenes(cells)
    rect = F.explode(F.array(*[
        F.struct(F.lit(i * 10 + j).alias("tile"), F.lit(i * 25).alias("row0"), F.lit(i * 25 + 24).alias("row1"), F.lit(j * 32).alias("col0"), F.lit(j * 32 + 31).alias("col1"))
        for i in range(2) for j in range(2)]))
    tiles = sc.select("scene", rect.alias("t")).select("scene", "t.*")
    # on every fourth scene the reference misses a whole tile, which must still be counted
    gap = (F.col("scene") % 4 == 1) & (F.col("row") >= 25) & (F.col("col") >= 32)
    refs = fx.g2(cells).withColumn("v", F.when(~gap, F.col("v")))
    return jobs.evaluate(wide, refs, fx.g3(cells), tiles, sc, a, b)


@query("v2_evaluate_tiles", fx.with_sql(*V2_CTES) + f"SELECT scene, CAST(tile AS INTEGER) AS tile, method, landscape, {sql_r(M)}, n_pixels, round(ndsm_rmse, 6) + 0.0 AS ndsm_rmse, ndsm_pixels FROM pt")
def v2(spark, d):
    return r6(evaluated(spark, d).select("scene", "tile", "method", "landscape", *M, "n_pixels", "ndsm_rmse", "ndsm_pixels"), [*M, "ndsm_rmse"])


@query("v2_evaluate_summary", fx.with_sql(*V2_CTES) + f"""
SELECT coalesce(landscape, 'all') AS landscape, method, count(*) AS tiles, {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in ev.SUMMARY_METRICS)} FROM pt GROUP BY GROUPING SETS ((landscape, method), (method))""")
def v2_summary(spark, d):
    return r6(jobs.evaluate_summary(evaluated(spark, d))[0], ev.SUMMARY_METRICS)


V3_CTES = [
    fx.G1, fx.G2, "sp0 AS (SELECT scene, row, col, CASE WHEN scene % 2 = 0 THEN g1.v ELSE (g1.v - 60) / 80 END AS pred, g2.v AS ref FROM g1 JOIN g2 USING (scene, row, col))",
    "fit AS (SELECT scene, regr_slope(ref, pred) AS a, regr_intercept(ref, pred) AS b FROM sp0 WHERE ref IS NOT NULL GROUP BY scene)",
    "sp AS (SELECT scene, CASE WHEN scene % 2 = 1 THEN a * pred + b ELSE pred END AS p, ref AS r FROM sp0 JOIN fit USING (scene) WHERE ref IS NOT NULL)", e1_sql("scene", "sp"),
]


def validated(spark, d):
    cells = fx.g1(spark, d)
    odd = F.col("scene") % 2 == 1
    pred = cells.withColumn("v", F.when(odd, (F.col("v") - 60.0) / 80.0).otherwise(F.col("v")))
    meta = cells.select("scene").distinct().withColumn("units", F.when(odd, "relative").otherwise("m"))
    mask = cells.where((F.col("row") + F.col("col")) % 9 == 0)
    # on two of three scenes the reference lies on a grid that starts three rows higher and two columns further left
    moved = F.col("scene") % 3 != 0
    ref = fx.g2(cells).withColumn("row", F.when(moved, F.col("row") + 3).otherwise(F.col("row"))).withColumn("col", F.when(moved, F.col("col") + 2).otherwise(F.col("col")))

    def affine(c, f):
        return F.struct(F.lit(0.5).alias("a"), F.lit(0.0).alias("b"), F.lit(c).alias("c"), F.lit(0.0).alias("d"), F.lit(-0.5).alias("e"), F.lit(f).alias("f"))

    grids = meta.where(moved).select("scene", affine(99.0, 201.5).alias("src"), affine(100.0, 200.0).alias("dst"))
    return jobs.validate(pred, ref, meta, mask, grids)


@query("v3_validate", fx.with_sql(*V3_CTES) + f"SELECT scene, CASE WHEN scene % 2 = 1 THEN 'relative' ELSE 'm' END AS units, {sql_r(M)}, n_pixels, scene % 2 = 1 AS scale_aligned, NULL::VARCHAR AS error FROM e1")
def v3(spark, d):
    return r6(validated(spark, d)[0], M)


@query("v3_validate_layers", fx.with_sql(*V3_CTES) + """
SELECT scene, row, col, round(rv, 6) + 0.0 AS reference, round(pred - rv, 6) + 0.0 AS error FROM (
  SELECT scene, row, col, pred, CASE WHEN (row + col) % 9 <> 0 THEN CASE WHEN scene % 2 = 1 THEN (ref - b) / a ELSE ref END END AS rv FROM sp0 JOIN fit USING (scene))""")
def v3_layers(spark, d):
    return r6(validated(spark, d)[1], ["reference", "error"])


# V4: one 24x24 site grid per customer; orders are catalogue items that cover part of a site's grid
COVER = "(item * 3 % 8)"
V4 = f"""nw AS (SELECT item, site, ts FROM ib JOIN sb ON ib.west <= sb.east AND sb.west <= ib.east AND ib.south <= sb.north AND sb.south <= ib.north),
ny AS (SELECT * FROM nw QUALIFY year(ts) = max(year(ts)) OVER (PARTITION BY site)),
cl AS (SELECT site, item, r AS row, c AS col FROM ny, range(0, 24) a(r), range(0, 24) b(c)),
mz AS (SELECT site, row, col, count(*) FILTER (row >= {COVER} AND item % 4 <> 0) AS lit,
  arg_min(item * 1.0::DOUBLE + row, item) FILTER ((row + col + item) % 6 <> 0) AS dsm FROM cl GROUP BY 1, 2, 3),
ok AS (SELECT site FROM mz GROUP BY site HAVING avg(CASE WHEN lit > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.7)"""


@query("v4_build_site", fx.with_sql(SITES, ITEMS, V4) + """
SELECT site AS scene, CAST(row // 8 AS INTEGER) AS r, CAST(col // 8 AS INTEGER) AS c, round(avg(CASE WHEN dsm IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) + 0.0 AS valid_frac
FROM mz JOIN ok USING (site) GROUP BY 1, 2, 3 HAVING avg(CASE WHEN dsm IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) >= 0.84""")
def v4(spark, d):
    from altigrid.operators.resample import grid_frame
    from altigrid.queries.joins import catalogue, site_boxes

    sites = site_boxes(spark, d).withColumnRenamed("site", "scene").withColumn("h", F.lit(24)).withColumn("w", F.lit(24))

    def cells(matched):
        return grid_frame(matched.select("scene", "item", joins.PLACE, F.lit(24).alias("h"), F.lit(24).alias("w")))

    def image(matched):
        lit = (F.col("row") >= F.col("item") * 3 % 8) & (F.col("item") % 4 != 0)
        level = F.when(lit, 100).otherwise(0)
        return cells(matched).select(*KEY, joins.PLACE, "item", F.col("item").alias("priority"), level.alias("r"), level.alias("g"), F.lit(0).alias("b"))

    def heights(matched):
        v = F.when((F.col("row") + F.col("col") + F.col("item")) % 6 != 0, F.col("item") * 1.0 + F.col("row"))
        return cells(matched).select(*KEY, joins.PLACE, F.col("item").alias("layer"), F.col("item").alias("priority"), v.alias("v"))

    return r6(jobs.build_site(catalogue(spark, d), sites, image, heights, heights, 8, 0.84, 0.7), ["valid_frac"])


