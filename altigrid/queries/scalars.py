"""Checked queries: per-cell expressions, text rules, coordinates and tile layout."""

from pyspark.sql import functions as F

from altigrid.functions import geo, labels, terrain, tiles
from altigrid.functions.imagery import select_bands
from altigrid.functions.numbers import rounded
from altigrid.model import meet
from altigrid.operators.stretch import normalize_relative, stretch
from altigrid.queries import fixtures as fx
from altigrid.queries.metrics import r6, sql_r
from altigrid.queries.registry import query
from altigrid.sources import grids, listings

NODATA_SQL = "nd AS (SELECT scene, row, col, CASE WHEN (row + col) % 13 = 0 THEN -9999.0::DOUBLE ELSE v END AS v, (row * col) % 19 <> 7 AS valid FROM g1)"


@query("a01_grid_scan", fx.with_sql(fx.G1, NODATA_SQL) + """
SELECT scene, row, col, round(CASE WHEN v <> -9999 AND valid THEN v END, 6) + 0.0 AS v FROM nd""")
def a01(spark, d):
    cells = fx.g1(spark, d).withColumn("v", F.when((F.col("row") + F.col("col")) % 13 == 0, -9999.0).otherwise(F.col("v")))
    valid = (F.col("row") * F.col("col")) % 19 != 7
    return cells.select("scene", "row", "col", rounded(grids.mark_missing(F.col("v"), valid=valid)).alias("v"))


@query("a02_array_grid_scan", fx.with_sql(fx.G1) + "SELECT scene, row, col, round(v, 6) + 0.0 AS v FROM g1")
def a02(spark, d):
    return r6(fx.g1(spark, d), ["v"])


@query("a06_split_list_scan", """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE CASE WHEN doc_id % 3 = 0 THEN 'gamus/' ELSE 'naip3dep/' END
  || source || '/' || CAST(doc_id AS VARCHAR) || '_1  # ' || lang END AS line FROM documents)
SELECT doc_id AS pos, trim(split_part(line, '#', 1)) AS tile,
  CASE WHEN starts_with(line, 'naip3dep/') THEN 'metric' WHEN starts_with(line, 'gamus/') THEN 'relative' END AS mode
FROM l WHERE trim(split_part(line, '#', 1)) <> ''""")
def a06(spark, d):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "gamus/").otherwise("naip3dep/"), "source", F.lit("/"), k.cast("string"), F.lit("_1  # "), "lang")
    lines = fx.table(spark, d, "documents").select(k.alias("pos"), F.when(k % 5 == 0, "").otherwise(name).alias("value"))
    return listings.split_entries(lines)


@query("a07_tile_path_parse", """
SELECT doc_id, 'naip3dep' AS dataset, source || '_x' AS site, CAST(doc_id % 7 AS INTEGER) AS r, CAST(doc_id % 11 AS INTEGER) AS c,
       CAST(doc_id % 7 AS VARCHAR) AS city, 'naip3dep/' || source || '_x' AS scene FROM documents""")
def a07(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("naip3dep/"), "source", F.lit("_x/"), (k % 7).cast("string"), F.lit("_"), (k % 11).cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", labels.parse_tile(path).alias("t")).select("doc_id", "t.*")


SITES = """sites AS (SELECT c_custkey AS site, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + (c_custkey % 10) / 10.0::DOUBLE AS lon,
  CAST(c_custkey * 17 % 160 - 80 AS DOUBLE) + (c_custkey % 8) / 8.0::DOUBLE AS lat FROM customer)"""


def sites(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        k.alias("site"), ((k * 37 % 360 - 180).cast("double") + (k % 10) / 10.0).alias("lon"),
        ((k * 17 % 160 - 80).cast("double") + (k % 8) / 8.0).alias("lat"),
    )


@query("a10_degree_tiles", fx.with_sql(SITES) + """
SELECT site, CAST(la AS INTEGER) AS tile_lat, CAST(lo AS INTEGER) AS tile_lon,
  'Copernicus_DSM_COG_10_' || CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(la) AS VARCHAR), 2, '0') || '_00_'
  || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lo) AS VARCHAR), 3, '0') || '_00_DEM' AS tile_name
FROM sites, range(-90, 91) a(la), range(-185, 190) o(lo)
WHERE la >= floor(lat - 0.3::DOUBLE) AND la < ceil(lat + 0.3::DOUBLE) AND lo >= floor(lon - 0.7::DOUBLE) AND lo < ceil(lon + 0.7::DOUBLE)""")
def a10(spark, d):
    s = sites(spark, d).select(
        "site", (F.col("lon") - 0.7).alias("w"), (F.col("lat") - 0.3).alias("s"),
        (F.col("lon") + 0.7).alias("e"), (F.col("lat") + 0.3).alias("n"),
    )
    return labels.degree_tiles(s, "w", "s", "e", "n").select("site", "tile_lat", "tile_lon", "tile_name")


@query("a11_tile_origins", """
SELECT p_partkey, CAST(s AS INTEGER) AS start FROM (
  SELECT p_partkey, 500 + p_partkey * 37 % 2000 AS len FROM part), range(0, 2600) t(s)
WHERE (len <= 518 AND s = 0) OR (len > 518 AND ((s % 259 = 0 AND s <= len - 518) OR s = len - 518))""")
def a11(spark, d):
    length = (500 + F.col("p_partkey") * 37 % 2000)
    return fx.table(spark, d, "part").select("p_partkey", F.explode(tiles.tile_origins(length, 518, 259)).alias("start"))


@query("a13_synthetic_grid", fx.with_sql(fx.G1, "dims AS (SELECT scene, max(row) + 1 AS h, max(col) + 1 AS w FROM g1 GROUP BY scene)") + """
SELECT scene, row, col,
  round(greatest(0, 100 * (1 - sqrt(pow((col + 0.5::DOUBLE - w / 2.0::DOUBLE) * 8, 2) + pow((row + 0.5::DOUBLE - h / 2.0::DOUBLE) * 8, 2)) / 400)), 6) + 0.0 AS cone,
  round(greatest(0, 100 * (1 - sqrt(pow((col + 0.5::DOUBLE - w / 2.0::DOUBLE) * 8, 2) + pow((row + 0.5::DOUBLE - h / 2.0::DOUBLE) * 8, 2)) / 400)) / 100, 6) + 0.0 AS relative,
  CASE WHEN row < h // 4 AND col < w // 4 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS corner,
  CAST((row // 64 + col // 64) % 2 AS INTEGER) AS checker,
  pow(row - h // 2, 2) + pow(col - w // 2, 2) <= 64 AS peak_dot
FROM g1 JOIN dims USING (scene)""")
def a13(spark, d):
    from altigrid.model import attach, scene_extent

    cells = fx.g1(spark, d)
    x = attach(cells, scene_extent(cells))
    row, col, h, w = F.col("row"), F.col("col"), F.col("h").cast("double"), F.col("w").cast("double")
    surfaces = [rounded(grids.synthetic_height(n, row, col, h, w, F.lit(8.0))).alias(n) for n in ("cone", "relative", "corner")]
    return x.select(
        "scene", "row", "col", *surfaces, grids.checkerboard(row, col).alias("checker"),
        grids.dot(row, col, F.floor(h / 2), F.floor(w / 2)).alias("peak_dot"),
    )


@query("c01_band_select", """
SELECT vec_id, CAST(CASE WHEN n >= 3 THEN embedding[3] ELSE embedding[1] END AS DOUBLE) AS r,
  CAST(CASE WHEN n >= 3 THEN embedding[2] ELSE embedding[1] END AS DOUBLE) AS g, CAST(embedding[1] AS DOUBLE) AS b
FROM (SELECT vec_id, embedding, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 64 END AS n FROM embeddings)""")
def c01(spark, d):
    n = F.element_at(F.array(*[F.lit(i) for i in (1, 2, 3, 64)]), (F.col("vec_id") % 4 + 1).cast("int"))
    e = fx.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), n).cast("array<double>").alias("bands"))
    return e.select("vec_id", select_bands("bands", (3, 2, 1)).alias("p")).select("vec_id", "p.r", "p.g", "p.b")


def _stretch_sql(p, levels, floor, src="g2"):
    return f"""ends AS (SELECT scene, quantile_cont(v, {p[0]}) AS lo, quantile_cont(v, {p[1]}) AS hi FROM {src} GROUP BY scene)
SELECT scene, row, col, CAST(floor(coalesce(least(greatest((v - lo) / greatest(hi - lo, {floor}), 0), 1), 0) * {levels} + 0.5) AS INTEGER) AS level
FROM {src} JOIN ends USING (scene)"""


@query("c02_stretch_8bit", fx.with_sql(fx.G1, fx.G2, _stretch_sql((0.02, 0.98), 255, 1e-6).split("\nSELECT")[0]) + "SELECT" + _stretch_sql((0.02, 0.98), 255, 1e-6).split("\nSELECT")[1].replace("least(greatest((v - lo) / greatest(hi - lo, 1e-06), 0), 1)", "CASE WHEN v IS NOT NULL THEN least(greatest((v - lo) / greatest(hi - lo, 1e-06), 0), 1) END"))
def c02(spark, d):
    return stretch(fx.g2(fx.g1(spark, d)), "v", ["scene"]).select("scene", "row", "col", "level")


@query("c03_normalize_relative", fx.with_sql(fx.G1, fx.G2, "ends AS (SELECT scene, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM g2 GROUP BY scene)") + """
SELECT scene, row, col, round(CASE WHEN v IS NOT NULL THEN least(greatest((v - lo) / greatest(hi - lo, 1.1920928955078125e-07), 0), 1) END, 6) + 0.0 AS v
FROM g2 JOIN ends USING (scene)""")
def c03(spark, d):
    return r6(normalize_relative(fx.g2(fx.g1(spark, d))).select("scene", "row", "col", "v"), ["v"])


@query("c04_stretch_16bit", fx.with_sql(fx.G1, fx.G2, "ends AS (SELECT scene, min(v) AS lo, max(v) AS hi FROM g2 GROUP BY scene)") + """
SELECT scene, row, col, CAST(floor(coalesce(CASE WHEN v IS NOT NULL THEN least(greatest((v - lo) / greatest(hi - lo, 1e-12), 0), 1) END, 0) * 65535 + 0.5) AS INTEGER) AS level
FROM g2 JOIN ends USING (scene)""")
def c04(spark, d):
    return stretch(fx.g2(fx.g1(spark, d)), "v", ["scene"], (0, 100), 65535, 1e-12).select("scene", "row", "col", "level")


def transform_of(k, px=0.5):
    return F.struct(
        F.lit(px).alias("a"), F.lit(0.0).alias("b"), (k * 10).cast("double").alias("c"),
        F.lit(0.0).alias("d"), F.lit(-px).alias("e"), (5000 - k * 3).cast("double").alias("f"),
    )


@query("c05_pixel_world", fx.with_sql(fx.POINTS) + """
SELECT point, round(0.5 * col_f + scene * 10, 6) + 0.0 AS x, round(-0.5 * row_f + 5000 - scene * 3, 6) + 0.0 AS y,
       round(col_f, 6) + 0.0 AS col_back, round(row_f, 6) + 0.0 AS row_back, 1.0::DOUBLE AS half_a FROM points""")
def c05(spark, d):
    t = transform_of(F.col("scene"))
    p = fx.points(spark, d).select("point", t.alias("t"), geo.pixel_to_world(t, "col_f", "row_f").alias("w"))
    p = p.withColumn("p", geo.world_to_pixel(F.col("t"), F.col("w.x"), F.col("w.y")))
    return p.select(
        "point", rounded("w.x").alias("x"), rounded("w.y").alias("y"), rounded("p.col").alias("col_back"),
        rounded("p.row").alias("row_back"), geo.scale_transform(F.col("t"), F.lit(2.0), F.lit(2.0))["a"].alias("half_a"),
    )


@query("c06_local_coordinates", fx.with_sql(fx.G1, "dims AS (SELECT scene, max(row) + 1 AS h, max(col) + 1 AS w FROM g1 GROUP BY scene)") + """
SELECT scene, row, col, round((col + 0.5 - w / 2.0) * 2.5, 6) + 0.0::DOUBLE AS x, round((row + 0.5 - h / 2.0) * 2.5, 6) + 0.0::DOUBLE AS z,
  round((col + 0.5::DOUBLE) / w, 6) + 0.0 AS u, round(1 - (row + 0.5::DOUBLE) / h, 6) + 0.0 AS t,
  round(CASE WHEN scene % 2 = 0 THEN v * 0.1::DOUBLE * greatest(h, w) * 2.5::DOUBLE ELSE v END, 6) + 0.0 AS shown FROM g1 JOIN dims USING (scene)""".replace("0.5 -", "0.5::DOUBLE -").replace("/ 2.0)", "/ 2.0::DOUBLE)").replace("* 2.5,", "* 2.5::DOUBLE,"))
def c06(spark, d):
    from altigrid.model import attach, scene_extent

    cells = fx.g1(spark, d)
    x = attach(cells, scene_extent(cells))
    units = F.when(F.col("scene") % 2 == 0, "relative").otherwise("m")
    x = x.select(
        "scene", "row", "col", terrain.local_xz("row", "col", "h", "w", F.lit(2.5)).alias("p"),
        terrain.uv("row", "col", "h", "w").alias("q"), terrain.display_height("v", units, "h", "w", F.lit(2.5)).alias("s"),
    )
    return x.select(
        "scene", "row", "col", rounded("p.x").alias("x"), rounded("p.z").alias("z"), rounded("q.u").alias("u"),
        rounded("q.v").alias("t"), rounded("s").alias("shown"),
    )


@query("c07_georeferenced", """
SELECT c_custkey, (c_custkey % 3 <> 0 AND c_custkey % 4 <> 0) AS absolute FROM customer""")
def c07(spark, d):
    k = F.col("c_custkey")
    flat = k % 4 == 0
    t = F.struct(*[
        F.when(flat, i).otherwise(o).alias(n)
        for n, i, o in zip("abcdef", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.5, 0.0, 100.0, 0.0, -0.5, 900.0))
    ])
    crs = F.when(k % 3 != 0, "EPSG:32633")
    return fx.table(spark, d, "customer").select("c_custkey", geo.is_georeferenced(crs, t).alias("absolute"))


ZONE = "CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER)"


@query("c08_utm_zone", fx.with_sql(SITES) + f"SELECT site, {ZONE} AS epsg FROM sites")
def c08(spark, d):
    return sites(spark, d).select("site", geo.utm_epsg("lon", "lat").alias("epsg"))


def _krueger_sql(src: str, lon="lon", lat="lat", out="utm") -> str:
    """Forward series in SQL over ``src`` with an ``epsg`` column; keeps every input column."""
    e = " + ".join(["eta"] + [f"({a!r}::DOUBLE) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1)])
    n = " + ".join(["xi"] + [f"({a!r}::DOUBLE) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1)])
    k = f"{geo.UTM_K0 * geo._RECTIFYING!r}::DOUBLE"
    c = f"{geo._CONFORMAL!r}::DOUBLE"
    return f"""{out}_1 AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {c} * atanh({c} * sin(radians({lat})))) AS kt,
    radians({lon}) - radians((epsg % 100) * 6 - 183) AS lam FROM {src}),
{out}_2 AS (SELECT *, atan2(kt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + kt * kt)) AS eta FROM {out}_1),
{out} AS (SELECT * EXCLUDE (kt, lam, xi, eta), 500000 + {k} * ({e}) AS x,
    CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + {k} * ({n}) AS y FROM {out}_2)"""


@query("c09_lonlat_utm", fx.with_sql(SITES, f"z AS (SELECT *, {ZONE} AS epsg FROM sites)", _krueger_sql("z")) + """
SELECT site, epsg, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(lon, 6) + 0.0 AS lon_back, round(lat, 6) + 0.0 AS lat_back FROM utm""")
def c09(spark, d):
    s = sites(spark, d).withColumn("epsg", geo.utm_epsg("lon", "lat"))
    s = geo.add_utm(s.select("site", "lon", "lat", "epsg"), "lon", "lat", "epsg")
    s = geo.add_lonlat(s, "x", "y", "epsg", "lon_back", "lat_back")
    return r6(r6(s.drop("lon", "lat"), ["x", "y"], 4), ["lon_back", "lat_back"])


@query("c10_ground_pixel_size", fx.with_sql(SITES, f"z AS (SELECT *, {ZONE} AS epsg FROM sites)",
    "c AS (SELECT site, epsg, k, lon + CASE k WHEN 1 THEN 0.01::DOUBLE ELSE 0 END AS plon, lat - CASE k WHEN 2 THEN 0.01::DOUBLE ELSE 0 END AS plat FROM z, range(0, 3) t(k))",
    _krueger_sql("c", "plon", "plat"),
    """s AS (SELECT site, sqrt(pow(max(x) FILTER (k = 1) - max(x) FILTER (k = 0), 2) + pow(max(y) FILTER (k = 1) - max(y) FILTER (k = 0), 2)) AS dx,
       sqrt(pow(max(x) FILTER (k = 2) - max(x) FILTER (k = 0), 2) + pow(max(y) FILTER (k = 2) - max(y) FILTER (k = 0), 2)) AS dy FROM utm GROUP BY site)""") + """
SELECT site, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy, round(least(dx, dy), 4) + 0.0 AS pixel_m, round(sqrt(dx * dy), 4) + 0.0 AS res_m FROM s""")
def c10(spark, d):
    # a 100x80 degree grid whose centre is the site
    t = F.struct(
        F.lit(0.01).alias("a"), F.lit(0.0).alias("b"), (F.col("lon") - 0.5).alias("c"),
        F.lit(0.0).alias("d"), F.lit(-0.01).alias("e"), (F.col("lat") + 0.4).alias("f"),
    )
    s = sites(spark, d).select("site", t.alias("t"), F.lit(4326).alias("epsg"), F.lit(80).alias("h"), F.lit(100).alias("w"))
    s = geo.add_ground_sides(s, "t", "epsg", "h", "w")
    return r6(s.select("site", "dx", "dy", "pixel_m", "res_m"), ["dx", "dy", "pixel_m", "res_m"], 4)


PATHS = """paths AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '/data/CartoDEM/x' WHEN 1 THEN '/d/copernicus/y' WHEN 2 THEN '/d/nasadem_srtm/z'
  WHEN 3 THEN '/d/SRTM/q' WHEN 4 THEN '/d/cdng4' || (doc_id % 10) || 'e' WHEN 5 THEN '/d/cdnxyze' ELSE '/d/' || source || '_tile' END || '.tif' AS path FROM documents)"""


@query("c11_dem_source_datum", fx.with_sql(PATHS, """s AS (SELECT doc_id, CASE WHEN contains(lower(path), 'carto') THEN 'cartodem' WHEN contains(lower(path), 'copernicus') THEN 'copernicus_glo30'
  WHEN contains(lower(path), 'nasadem') THEN 'nasadem' WHEN contains(lower(path), 'srtm') THEN 'srtm'
  WHEN regexp_matches(path, '/cdn.[0-9][0-9].\\.tif$') THEN 'cartodem' ELSE regexp_extract(path, '([^/]*)\\.tif$', 1) END AS source FROM paths)""") + """
SELECT doc_id, source, CASE source WHEN 'copernicus_glo30' THEN 'EGM2008' WHEN 'cartodem' THEN 'WGS84 ellipsoid (measured, V3R1)'
  WHEN 'srtm' THEN 'EGM96' WHEN 'nasadem' THEN 'EGM96' ELSE 'unknown' END AS datum FROM s""")
def c11(spark, d):
    k = F.col("doc_id")
    forms = [F.lit("/data/CartoDEM/x"), F.lit("/d/copernicus/y"), F.lit("/d/nasadem_srtm/z"), F.lit("/d/SRTM/q"),
             F.concat(F.lit("/d/cdng4"), (k % 10).cast("string"), F.lit("e")), F.lit("/d/cdnxyze"), F.concat(F.lit("/d/"), "source", F.lit("_tile"))]
    path = F.concat(F.element_at(F.array(*forms), (k % 7 + 1).cast("int")), F.lit(".tif"))
    s = fx.table(spark, d, "documents").select("doc_id", labels.infer_source(path).alias("source"))
    return s.withColumn("datum", labels.datum_of("source"))


@query("c13_taper_weights", fx.with_sql(fx.G1, """t AS (SELECT scene, row, col, y0, x0 FROM g1,
  (VALUES (0), (8), (16), (24), (32), (34)) a(y0), (VALUES (0), (8), (16), (24), (32), (40), (48)) b(x0)
  WHERE row >= y0 AND row < y0 + 16 AND col >= x0 AND col < x0 + 16)""") + """
SELECT scene, row, col, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0, round(
  (CASE WHEN (y0 = 0 AND row - y0 < 8) OR (y0 + 16 >= 50 AND row - y0 >= 8) THEN 1 ELSE pow(sin(pi() * (row - y0 + 0.5) / 16), 2) END) *
  (CASE WHEN (x0 = 0 AND col - x0 < 8) OR (x0 + 16 >= 64 AND col - x0 >= 8) THEN 1 ELSE pow(sin(pi() * (col - x0 + 0.5) / 16), 2) END), 6) + 0.0 AS weight
FROM t""")
def c13(spark, d):
    from altigrid.operators.tiling import explode_overlaps

    cells = fx.g1(spark, d)
    x = explode_overlaps(cells, fx.layout(cells), 16, 8)
    return x.select(
        "scene", "row", "col", "y0", "x0", rounded(tiles.tile_weight("row", "col", "y0", "x0", 16, "h", "w")).alias("weight")
    )


@query("c16_normalised_error", fx.with_sql(fx.G1, fx.G2, """er AS (SELECT scene, row, col, g1.v - g2.v AS e FROM g1 JOIN g2 USING (scene, row, col))""",
  "md AS (SELECT scene, quantile_cont(e, 0.5) AS med FROM er GROUP BY scene)",
  "nm AS (SELECT scene, 1.4826::DOUBLE * quantile_cont(abs(e - med), 0.5) AS nmad FROM er JOIN md USING (scene) GROUP BY scene)") + """
SELECT scene, row, col, round(CASE WHEN e IS NOT NULL THEN least(greatest(e / greatest(3 * CASE WHEN nmad IS NULL OR nmad = 0 THEN 1 ELSE nmad END, 1e-6), -1), 1) END, 6) + 0.0 AS share
FROM er JOIN nm USING (scene)""")
def c16(spark, d):
    from altigrid.operators.surface import normalised_error
    from altigrid.queries.metrics import scene_pairs

    return r6(normalised_error(scene_pairs(spark, d), "pred", "ref", ["scene"]).select("scene", "row", "col", "share"), ["share"])


@query("c17_terrain_classes", fx.with_sql(fx.G1, fx.G2, "rg AS (SELECT scene, min(v) AS lo, max(v) AS hi FROM g2 GROUP BY scene)") + """
SELECT scene, row, col, round(CASE WHEN v IS NOT NULL THEN least(greatest((v - lo) / greatest(hi - lo, 0.001), 0), 1) END, 6) + 0.0 AS height_share,
  CAST(floor((v - lo) / 5) AS BIGINT) AS band,
  round(abs((v - lo) / 5 + 0.5 - floor((v - lo) / 5 + 0.5) - 0.5), 6) + 0.0 AS line_distance
FROM g2 JOIN rg USING (scene)""")
def c17(spark, d):
    from altigrid.operators.surface import terrain_classes

    out = terrain_classes(fx.g2(fx.g1(spark, d)), 5.0)
    return r6(out.select("scene", "row", "col", "height_share", "band", "line_distance"), ["height_share", "line_distance"])


@query("c18_object_mask", fx.with_sql(fx.G1, fx.G2, fx.G3) + """
SELECT scene, row, col, coalesce(g2.v - g3.v > 2.5, false) AS is_object FROM g2 JOIN g3 USING (scene, row, col)""")
def c18(spark, d):
    cells = fx.g1(spark, d)
    both = meet(fx.g2(cells).withColumnRenamed("v", "dsm"), fx.g3(cells).withColumnRenamed("v", "dtm"))
    return both.select("scene", "row", "col", terrain.object_mask("dsm", "dtm").alias("is_object"))


@query("c20_report_format", fx.with_sql(fx.PER_TILE) + """
SELECT tile, coalesce(printf('%.2f', rmse), '–') AS rmse, coalesce(printf('%.3f', pearson_r), '–') AS r, coalesce(printf('%.2f', nmad), '–') AS nmad FROM per_tile""")
def c20(spark, d):
    return fx.per_tile(spark, d).select("tile", labels.fmt("rmse").alias("rmse"), labels.fmt("pearson_r", 3).alias("r"), labels.fmt("nmad").alias("nmad"))
