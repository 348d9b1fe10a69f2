"""Checked queries: range, footprint, mosaic, mask and dimension joins."""

from pyspark.sql import functions as F

from altigrid.functions import geo
from altigrid.functions.numbers import rounded
from altigrid.model import meet, scene_extent
from altigrid.operators import joins
from altigrid.queries import fixtures as fx
from altigrid.queries.metrics import r6, scene_pairs
from altigrid.queries.registry import query
from altigrid.queries.scalars import SITES, ZONE, _krueger_sql, sites

KEY = ["scene", "row", "col"]


@query("d02_window_range_join", fx.with_sql(fx.G1, f"""rects AS (SELECT o_orderkey AS tile, o_orderkey % {fx.SCENE_COUNT} AS scene, CAST(o_orderkey * 7 % 45 AS BIGINT) AS r0, CAST(o_orderkey * 11 % 60 AS BIGINT) AS c0,
  o_orderkey % 6 AS hh, o_orderkey % 9 AS ww FROM orders)""") + """
SELECT tile, scene, row, col, round(v, 6) + 0.0 AS v FROM g1 JOIN rects USING (scene) WHERE row BETWEEN r0 AND r0 + hh AND col BETWEEN c0 AND c0 + ww""")
def d02(spark, d):
    k = F.col("o_orderkey")
    px, origin_x, origin_y = 0.5, 100.0, 900.0
    t = fx.table(spark, d, "orders").select(
        k.alias("tile"), (k % fx.scene_count(spark, d)).alias("scene"), (origin_x + (k * 11 % 60) * px).alias("c"), (origin_y - (k * 7 % 45) * px).alias("f"),
        (k % 6 + 1).alias("h"), (k % 9 + 1).alias("w"),
    )
    cells = fx.g1(spark, d)
    s = cells.select("scene").distinct().select("scene", F.lit(px).alias("a"), F.lit(origin_x).alias("c"), F.lit(-px).alias("e"), F.lit(origin_y).alias("f"))
    out = joins.cells_in_tiles(cells, joins.tile_rectangles(t, s), bucket=16)
    return r6(out.select("tile", *KEY, "v"), ["v"])


ITEMS = """items AS (SELECT o_orderkey AS item, o_orderdate AS ts, CAST(o_orderkey * 13 % 358 - 179 AS DOUBLE) + 0.25::DOUBLE AS west, CAST(o_orderkey * 29 % 158 - 79 AS DOUBLE) + 0.5::DOUBLE AS south FROM orders),
ib AS (SELECT *, west + 0.5::DOUBLE + (item % 5) / 4.0::DOUBLE AS east, south + 0.5::DOUBLE + (item % 3) / 4.0::DOUBLE AS north FROM items),
sb AS (SELECT site, lon - 0.75::DOUBLE AS west, lat - 0.5::DOUBLE AS south, lon + 0.75::DOUBLE AS east, lat + 0.5::DOUBLE AS north FROM sites)"""


def catalogue(spark, d):
    k = F.col("o_orderkey")
    i = fx.table(spark, d, "orders").select(
        k.alias("item"), F.col("o_orderdate").alias("ts"), ((k * 13 % 358 - 179).cast("double") + 0.25).alias("west"), ((k * 29 % 158 - 79).cast("double") + 0.5).alias("south"))
    return i.withColumn("east", F.col("west") + 0.5 + (F.col("item") % 5) / 4.0).withColumn("north", F.col("south") + 0.5 + (F.col("item") % 3) / 4.0)


def site_boxes(spark, d):
    return sites(spark, d).select("site", (F.col("lon") - 0.75).alias("west"), (F.col("lat") - 0.5).alias("south"), (F.col("lon") + 0.75).alias("east"), (F.col("lat") + 0.5).alias("north"))


@query("d04_footprint_join", fx.with_sql(SITES, ITEMS) + """
SELECT item, site FROM ib JOIN sb ON ib.west <= sb.east AND sb.west <= ib.east AND ib.south <= sb.north AND sb.south <= ib.north""")
def d04(spark, d):
    return joins.join_footprints(catalogue(spark, d), site_boxes(spark, d)).select("item", "site")


@query("d04_site_square", fx.with_sql(SITES, f"z AS (SELECT *, {ZONE} AS epsg FROM sites)", _krueger_sql("z")) + """
SELECT site, epsg, round(500100.3::DOUBLE + round_even((x - 1000 / 2.0 * 0.6::DOUBLE - 500100.3::DOUBLE) / 0.6::DOUBLE, 0)::DOUBLE * 0.6::DOUBLE, 4) + 0.0 AS left_x,
  round(4000200.1::DOUBLE + round_even((y + 1000 / 2.0 * 0.6::DOUBLE - 4000200.1::DOUBLE) / 0.6::DOUBLE, 0)::DOUBLE * 0.6::DOUBLE, 4) + 0.0 AS top_y FROM utm""")
def d04_square(spark, d):
    s = sites(spark, d).withColumn("epsg", geo.utm_epsg("lon", "lat"))
    out = joins.site_squares(s, 1000, 0.6, 500100.3, 4000200.1)
    return out.select("site", "epsg", rounded("left_x", 4).alias("left_x"), rounded("top_y", 4).alias("top_y"))


@query("d05_latest_year", """
SELECT o_orderkey AS item, o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
QUALIFY year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey)""")
def d05(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("ts"))
    return joins.latest_year(o, ["site"]).select("item", "site", "year")


LAYERS = """ly AS (SELECT scene, row, col, 'l' || p AS layer, CAST(p AS INTEGER) AS priority,
  CASE WHEN (row + col) % 3 <> p - 1 AND (row * 5 + col * p) % 7 <> 0 THEN v + p * 100 END AS v FROM g1, range(1, 4) t(p))"""


def layers(cells):
    p = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("priority")
    x = cells.select(*KEY, "v", p)
    hole = ((F.col("row") + F.col("col")) % 3 == F.col("priority") - 1) | ((F.col("row") * 5 + F.col("col") * F.col("priority")) % 7 == 0)
    return x.select(*KEY, F.concat(F.lit("l"), F.col("priority").cast("string")).alias("layer"), "priority", F.when(~hole, F.col("v") + F.col("priority") * 100.0).alias("v"))


@query("d06_priority_mosaic", fx.with_sql(fx.G1, LAYERS) + """
SELECT scene, row, col, round(arg_min(v, priority) FILTER (v IS NOT NULL), 6) + 0.0 AS v, arg_min(layer, priority) FILTER (v IS NOT NULL) AS layer_used FROM ly GROUP BY 1, 2, 3""")
def d06(spark, d):
    return r6(joins.mosaic(layers(fx.g1(spark, d))), ["v"])


@query("d06_mosaic_coverage", fx.with_sql(fx.G1, LAYERS) + """
SELECT scene, round(avg(ok), 6) + 0.0 AS coverage, CASE WHEN avg(ok) = 0 THEN 'error' WHEN avg(ok) < 1 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT scene, CASE WHEN count(v) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM ly GROUP BY scene, row, col) GROUP BY scene""")
def d06_report(spark, d):
    return r6(joins.mosaic_report(joins.mosaic(layers(fx.g1(spark, d)))), ["coverage"])


IMAGES = """im AS (SELECT scene, row, col, 'i' || p AS item, CAST(p AS INTEGER) AS priority,
  CASE WHEN (row + p) % 4 = 0 OR (scene % 3 = 0 AND row < 3) THEN 0 ELSE CAST(10 + p AS INTEGER) END AS r, CASE WHEN (row + p) % 4 = 0 OR (scene % 3 = 0 AND row < 3) THEN 0 ELSE CAST(col AS INTEGER) END AS g, 0 AS b
  FROM g1, range(1, 4) t(p)),
mz AS (SELECT scene, row, col, min(priority) FILTER (r <> 0 OR g <> 0 OR b <> 0) AS p FROM im GROUP BY 1, 2, 3),
rp AS (SELECT scene, avg(CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS coverage, string_agg(DISTINCT 'i' || p, ',' ORDER BY 'i' || p) AS items_used FROM mz GROUP BY scene)"""


def images(cells):
    p = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("priority")
    x = cells.select(*KEY, p)
    dark = ((F.col("row") + F.col("priority")) % 4 == 0) | ((F.col("scene") % 3 == 0) & (F.col("row") < 3))
    zero = F.lit(0)
    return x.select(
        *KEY, F.concat(F.lit("i"), F.col("priority").cast("string")).alias("item"), "priority", F.when(dark, zero).otherwise(F.col("priority") + 10).alias("r"),
        F.when(dark, zero).otherwise(F.col("col")).alias("g"), zero.alias("b"))


@query("d07_image_mosaic", fx.with_sql(fx.G1, IMAGES) + """
SELECT mz.scene, mz.row, mz.col, im.r, im.g, im.b FROM mz JOIN rp USING (scene) JOIN im ON im.scene = mz.scene AND im.row = mz.row AND im.col = mz.col AND im.priority = mz.p WHERE coverage >= 0.999""")
def d07(spark, d):
    return joins.mosaic_images(images(fx.g1(spark, d)))[0]


@query("d07_image_mosaic_report", fx.with_sql(fx.G1, IMAGES) + "SELECT scene, round(coverage, 6) + 0.0 AS coverage, items_used, coverage >= 0.999 AS accepted FROM rp")
def d07_report(spark, d):
    return r6(joins.mosaic_images(images(fx.g1(spark, d)))[1], ["coverage"])


@query("d09_mask_anti_join", fx.with_sql(fx.G1, fx.G2) + """
SELECT g1.scene, g1.row, g1.col, round(CASE WHEN g2.v IS NOT NULL THEN g1.v END, 6) + 0.0 AS v FROM g1 JOIN g2 USING (scene, row, col)""")
def d09(spark, d):
    cells = fx.g1(spark, d)
    return r6(joins.apply_mask(cells, fx.g2(cells).where("v IS NULL")), ["v"])


@query("d10_grid_alignment", fx.with_sql(fx.G1, "dm AS (SELECT scene, max(row) + 1 AS h, max(col) + 1 AS w FROM g1 GROUP BY scene)") + """
SELECT scene, CASE scene % 5 WHEN 1 THEN 'width' WHEN 2 THEN 'crs' WHEN 3 THEN 'bounds' END AS mismatch FROM dm""")
def d10(spark, d):
    from altigrid.model import META_SCHEMA

    ext = scene_extent(fx.g1(spark, d))
    k = F.col("scene") % 5
    num = lambda c: F.col(c).cast("double")
    crs, box = F.lit("EPSG:32644"), F.array(F.lit(0.0), F.lit(0.0), num("w"), num("h"))
    base = F.to_json(F.struct(num("w").alias("width"), num("h").alias("height"), F.lit(1.0).alias("pixel_size_m"), F.lit("m").alias("units"), crs.alias("crs"), box.alias("bounds")))
    other = F.to_json(F.struct(  # the same keys in another order
        F.when(k == 3, F.array(F.lit(1.0), F.lit(0.0), num("w"), num("h"))).otherwise(box).alias("bounds"), F.when(k == 2, F.lit("EPSG:32645")).otherwise(crs).alias("crs"),
        F.lit("m").alias("units"), F.lit(1.0).alias("pixel_size_m"), num("h").alias("height"), F.when(k == 1, num("w") + 1).otherwise(num("w")).alias("width")))
    metas = [ext.select("scene", F.from_json(t, META_SCHEMA).alias("m")).select("scene", "m.*") for t in (base, other)]
    return joins.check_alignment(*metas)


@query("d11_enrichment", """
SELECT n_nationkey, n_name, coalesce(CASE WHEN r_regionkey <> 2 THEN r_name END, 'cause not written yet') AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def d11(spark, d):
    n = fx.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    r = fx.table(spark, d, "region").withColumn("r_name", F.when(F.col("r_regionkey") != 2, F.col("r_name")))
    return joins.enrich(n, r, "r_regionkey", {"r_name": "cause not written yet"}).select("n_nationkey", "n_name", "r_name")


@query("d12_palette_lookup", fx.with_sql(fx.G1, "pal AS (SELECT DISTINCT CAST(p_size * 5 AS INTEGER) AS idx FROM part WHERE p_size * 5 <= 255)") + """
SELECT scene, row, col, CASE WHEN idx IS NULL THEN 0 ELSE CAST(idx AS INTEGER) END AS r, CASE WHEN idx IS NULL THEN 0 ELSE CAST(255 - idx AS INTEGER) END AS g, CASE WHEN idx IS NULL THEN 0 ELSE 7 END AS b
FROM (SELECT *, (row * 64 + col) % 256 AS k FROM g1) LEFT JOIN pal ON idx = k""")
def d12(spark, d):
    cells = fx.g1(spark, d).select(*KEY, ((F.col("row") * 64 + F.col("col")) % 256).alias("k"))
    pal = fx.table(spark, d, "part").select((F.col("p_size") * 5).cast("int").alias("idx")).distinct()
    pal = pal.select("idx", F.col("idx").alias("r"), (255 - F.col("idx")).alias("g"), F.lit(7).alias("b"))
    return joins.apply_palette(cells, pal, "k").select(*KEY, "r", "g", "b")


@query("d14_surface_difference", fx.with_sql(fx.G1, fx.G2, "ft AS (SELECT scene, regr_slope(g2.v, g1.v) AS a, regr_intercept(g2.v, g1.v) AS b FROM g1 JOIN g2 USING (scene, row, col) GROUP BY scene)") + """
SELECT scene, row, col, round(g1.v - g2.v, 6) + 0.0 AS diff, round((g2.v - b) / a, 6) + 0.0 AS rel FROM g1 JOIN g2 USING (scene, row, col) JOIN ft USING (scene)""")
def d14(spark, d):
    from altigrid.operators.metrics import affine_fit

    cells = fx.g1(spark, d)
    ref = fx.g2(cells)
    fit = affine_fit(scene_pairs(spark, d), "pred", "ref", ["scene"])
    rel = joins.to_relative_units(ref, fit).withColumnRenamed("v", "rel")
    return r6(meet(joins.difference(cells, ref).withColumnRenamed("v", "diff"), rel), ["diff", "rel"])


