"""Checked queries: accuracy metrics (E1-E5, E16, E21, E26), pair filters and roll-ups."""

from pyspark.sql import functions as F

from altigrid.functions.numbers import rounded
from altigrid.model import meet
from altigrid.operators import joins, metrics
from altigrid.queries import fixtures as fx
from altigrid.queries.registry import query

M = metrics.METRICS


def r6(df, cols, digits=6):
    return df.select(*[rounded(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def sql_r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


# E1 in SQL over a relation ``(<by>, p, r)``; a pair counts when both are there, a group always has a row
def e1_sql(by: str, src: str) -> str:
    valid = "FILTER (WHERE p - r IS NOT NULL)"
    return f"""
e1_med AS (SELECT {by}, quantile_cont(p - r, 0.5) AS med FROM {src} GROUP BY {by}),
e1_all AS (
  SELECT {by}, sqrt(avg((p - r) * (p - r))) AS rmse, avg(abs(p - r)) AS mae,
         CASE WHEN max(p) {valid} > min(p) {valid} AND max(r) {valid} > min(r) {valid} THEN corr(p, r) ELSE 0 END AS pearson_r,
         avg(p - r) AS bias, 1.4826::DOUBLE * quantile_cont(abs(p - r - med), 0.5) AS nmad,
         sqrt(avg((p - r - med) * (p - r - med))) AS offset_free_rmse, count(p - r) AS n_pixels
  FROM {src} JOIN e1_med USING ({by}) GROUP BY {by}),
e1 AS (SELECT {by}, {", ".join(f"CASE WHEN n_pixels >= 2 THEN {m} END AS {m}" for m in M)}, n_pixels FROM e1_all)"""


SCENE_PAIRS = """sp AS (
  SELECT scene, g1.v AS p, g2.v AS r FROM g1 JOIN g2 USING (scene, row, col) WHERE g2.v IS NOT NULL)"""


def scene_pairs(spark, d):
    cells = fx.g1(spark, d)
    return joins.join_cells(cells, fx.g2(cells))


@query("d01_cell_join", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, row, col, round(g1.v, 6) + 0.0 AS pred, round(g2.v, 6) + 0.0 AS ref
FROM g1 JOIN g2 USING (scene, row, col)""")
def d01(spark, d):
    return r6(scene_pairs(spark, d), ["pred", "ref"])


def stored_pair(spark, d):
    """Both grids stored in strips of as many buckets."""
    from altigrid.sources import strips

    cells = fx.g1(spark, d)
    n = strips.bucket_count(cells)
    return strips.store_grid(cells, "g1", n), strips.store_grid(fx.g2(cells), "g2", n)


@query("d01_stored_join", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, row, col, round(g1.v, 6) + 0.0 AS pred, round(g2.v, 6) + 0.0 AS ref
FROM g1 JOIN g2 USING (scene, row, col)""")
def d01_stored(spark, d):
    return r6(joins.join_cells(*stored_pair(spark, d)), ["pred", "ref"])


@query("d09_stored_mask", fx.with_sql(fx.G1, fx.G2) + """
SELECT g1.scene, g1.row, g1.col, round(CASE WHEN g2.v IS NULL THEN g1.v END, 6) + 0.0 AS v FROM g1 JOIN g2 USING (scene, row, col)""")
def d09_stored(spark, d):
    return r6(joins.apply_mask(*stored_pair(spark, d)), ["v"])


@query("e02_stored_compare", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, round(sqrt(avg((g1.v - g2.v) * (g1.v - g2.v))), 6) + 0.0 AS rmse, round(avg(abs(g1.v - g2.v)), 6) + 0.0 AS mae,
       round(avg(g1.v - g2.v), 6) + 0.0 AS bias, count(g1.v - g2.v) AS count, round(max(abs(g1.v - g2.v)), 6) + 0.0 AS max_abs
FROM g1 JOIN g2 USING (scene, row, col) GROUP BY scene""")
def e02_stored(spark, d):
    return r6(metrics.compare(joins.join_cells(*stored_pair(spark, d)), "pred", "ref", ["scene"]), ["rmse", "mae", "bias", "max_abs"])


@query("c19_valid_pairs", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, row, col, round(g1.v, 6) + 0.0 AS pred, round(g2.v, 6) + 0.0 AS ref
FROM g1 JOIN g2 USING (scene, row, col) WHERE g2.v IS NOT NULL AND g1.v IS NOT NULL""")
def c19(spark, d):
    return r6(joins.valid_pairs(scene_pairs(spark, d), "pred", "ref"), ["pred", "ref"])


@query("e01_dsm_metrics", fx.with_sql(fx.G1, fx.G2, SCENE_PAIRS, e1_sql("scene", "sp")) + f"SELECT scene, {sql_r(M)}, n_pixels FROM e1")
def e01(spark, d):
    return r6(metrics.dsm_metrics(scene_pairs(spark, d), "pred", "ref", ["scene"]), M)


@query("e01_dsm_metrics_pairs", fx.with_sql(fx.PAIRS, "pp AS (SELECT l_returnflag || l_linestatus AS grp, pred AS p, ref AS r FROM pairs)", e1_sql("grp", "pp")) + f"SELECT grp, {sql_r(M, 4)}, n_pixels FROM e1")
def e01_pairs(spark, d):
    p = fx.pairs(spark, d).withColumn("grp", F.concat("l_returnflag", "l_linestatus"))
    return r6(metrics.dsm_metrics(p, "pred", "ref", ["grp"]), M, 4)


@query("e01_dsm_metrics_objects", fx.with_sql(fx.G1, fx.G2, fx.G3, """op AS (
  SELECT scene, CASE WHEN g2.v - g3.v > 2.5 THEN g1.v END AS p, g2.v AS r FROM g1 JOIN g2 USING (scene, row, col) JOIN g3 USING (scene, row, col))""", e1_sql("scene", "op")) + f"SELECT scene, {sql_r(M)}, n_pixels FROM e1")
def e01_objects(spark, d):
    cells = fx.g1(spark, d)
    trio = meet(joins.join_cells(cells, fx.g2(cells)), fx.g3(cells).select("scene", "row", "col", F.col("v").alias("dtm")))
    from altigrid.functions.terrain import object_mask

    return r6(metrics.dsm_metrics(trio, "pred", "ref", ["scene"], object_mask("ref", "dtm")), M)


@query("e02_compare", fx.with_sql(fx.PAIRS) + """
SELECT l_returnflag, l_linestatus, round(sqrt(avg((pred - ref) * (pred - ref))), 4) + 0.0 AS rmse,
       round(avg(abs(pred - ref)), 4) + 0.0 AS mae, round(avg(pred - ref), 4) + 0.0 AS bias, count(*) AS count,
       round(max(abs(pred - ref)), 4) + 0.0 AS max_abs
FROM pairs GROUP BY 1, 2""")
def e02(spark, d):
    out = metrics.compare(fx.pairs(spark, d), "pred", "ref", ["l_returnflag", "l_linestatus"])
    return r6(out, ["rmse", "mae", "bias", "max_abs"], 4)


@query("e03_finite_range", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, round(min(v), 6) + 0.0 AS min_h, round(max(v), 6) + 0.0 AS max_h, count(v) AS count,
       CASE WHEN count(v) = 0 THEN 'no finite elevations' END AS error
FROM g2 GROUP BY scene""")
def e03(spark, d):
    return r6(metrics.finite_range(fx.g2(fx.g1(spark, d)), ["scene"]), ["min_h", "max_h"])


@query("e04_relative_metrics", fx.with_sql(fx.G1, fx.G2, SCENE_PAIRS, """fit AS (
  SELECT scene, regr_slope(r, p) AS align_a, regr_intercept(r, p) AS align_b FROM sp GROUP BY scene)""",
  "al AS (SELECT scene, align_a * p + align_b AS p, r FROM sp JOIN fit USING (scene))", e1_sql("scene", "al")) + f"""
SELECT scene, {sql_r(M)}, n_pixels, round(align_a, 6) + 0.0 AS align_a, round(align_b, 6) + 0.0 AS align_b
FROM e1 JOIN fit USING (scene)""")
def e04(spark, d):
    return r6(metrics.relative_metrics(scene_pairs(spark, d), "pred", "ref", ["scene"]), [*M, "align_a", "align_b"])


@query("e05_polarity", fx.with_sql(fx.G1, fx.G2, SCENE_PAIRS) + "SELECT scene, round(corr(p, r), 6) + 0.0 AS r FROM sp GROUP BY scene")
def e05(spark, d):
    return r6(metrics.polarity(scene_pairs(spark, d), "pred", "ref", ["scene"]), ["r"])


@query("e05_polarity_verdict", fx.with_sql(fx.PAIRS, """pol AS (
  SELECT l_returnflag, l_linestatus, corr(pred, ref) AS r FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2)""") + """
SELECT tiles, round(mean_r, 6) + 0.0 AS mean_r, negative,
       CASE WHEN mean_r <= 0 OR negative > tiles / 2.0 THEN 'flipped' WHEN negative > 0 THEN 'warning' ELSE 'ok' END AS verdict
FROM (SELECT count(*) AS tiles, avg(r) AS mean_r, CAST(count_if(r < 0) AS BIGINT) AS negative FROM pol)""")
def e05_verdict(spark, d):
    p = metrics.polarity(fx.pairs(spark, d), "pred", "ref", ["l_returnflag", "l_linestatus"])
    return r6(metrics.polarity_verdict(p), ["mean_r"])


@query("e16_coverage", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, round(avg(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) + 0.0 AS coverage FROM g2 GROUP BY scene""")
def e16(spark, d):
    return r6(metrics.coverage(fx.g2(fx.g1(spark, d)), ["scene"]), ["coverage"])


@query("e26_ssi_l1", fx.with_sql(fx.G1, fx.G2, SCENE_PAIRS, """med AS (
  SELECT scene, quantile_disc(p, 0.5) AS mp, quantile_disc(r, 0.5) AS mr FROM sp GROUP BY scene)""",
  """cen AS (SELECT scene, p - mp AS cp, r - mr AS cr FROM sp JOIN med USING (scene))""",
  """sc AS (SELECT scene, greatest(avg(abs(cp)), 1e-6) AS s1, greatest(avg(abs(cr)), 1e-6) AS s2 FROM cen GROUP BY scene)""") + """
SELECT scene, round(avg(abs(cp / s1 - cr / s2)), 6) + 0.0 AS ssi_l1 FROM cen JOIN sc USING (scene) GROUP BY scene""")
def e26(spark, d):
    return r6(metrics.ssi_l1(scene_pairs(spark, d), "pred", "ref", ["scene"]), ["ssi_l1"])


GEOID = "geo AS (SELECT scene, row, col, 40.0::DOUBLE + row * 0.01::DOUBLE - col * 0.02::DOUBLE AS n FROM g1)"


def geoid_like(cells):
    return cells.select("scene", "row", "col", (40.0 + F.col("row") * 0.01 - F.col("col") * 0.02).alias("v"))


D13 = """three AS (
  SELECT scene, row, col, g1.v + n AS a, g2.v AS b, n
  FROM g1 JOIN g2 USING (scene, row, col) JOIN geo USING (scene, row, col) WHERE g2.v IS NOT NULL)"""


def three(spark, d):
    cells = fx.g1(spark, d)
    geo = geoid_like(cells)
    ell = joins.join_cells(cells, geo, names=("a", "n")).select("scene", "row", "col", (F.col("a") + F.col("n")).alias("v"))
    return joins.join_three(ell, fx.g2(cells), geo)


@query("d13_three_layer_agreement", fx.with_sql(fx.G1, fx.G2, GEOID, D13) + f"SELECT scene, row, col, {sql_r(['a', 'b', 'n'])} FROM three")
def d13(spark, d):
    return r6(three(spark, d), ["a", "b", "n"])


@query("e21_datum_check", fx.with_sql(fx.G1, fx.G2, GEOID, D13, "dm AS (SELECT scene, quantile_cont(a - b, 0.5) AS med FROM three GROUP BY scene)") + """
SELECT scene, count(*) AS cells, round(corr(a, b), 6) + 0.0 AS pearson_r, round(min(n), 6) + 0.0 AS geoid_min,
       round(max(n), 6) + 0.0 AS geoid_max, round(any_value(med), 6) + 0.0 AS diff_median,
       round(quantile_cont(n, 0.5), 6) + 0.0 AS geoid_median, round(quantile_cont(a - n - b, 0.5), 6) + 0.0 AS corrected_median,
       round(1.4826::DOUBLE * quantile_cont(abs(a - b - med), 0.5), 6) + 0.0 AS diff_nmad
FROM three JOIN dm USING (scene) GROUP BY scene""")
def e21(spark, d):
    cols = ["pearson_r", "geoid_min", "geoid_max", "diff_median", "geoid_median", "corrected_median", "diff_nmad"]
    return r6(metrics.datum_check(three(spark, d), ["scene"]), cols)
