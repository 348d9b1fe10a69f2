"""Composite jobs on grids with known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from altigrid.plans import jobs


def affine(a, c, e, f):
    return F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit(c).alias("c"), F.lit(0.0).alias("d"), F.lit(e).alias("e"), F.lit(f).alias("f"))


def plane(h, w, x0, y0, px):
    """Heights 2x + 3y at the cell centres of a grid."""
    r, c = np.mgrid[0:h, 0:w]
    return 2 * (x0 + (c + 0.5) * px) + 3 * (y0 - (r + 0.5) * px)


def test_validate_aligns_the_reference(spark, to_cells):
    """Scene 0: another origin, pixel size and extent; 1: same size, no georeference; 2: another size, none."""
    pred = to_cells(plane(12, 10, 0, 0, 1.0) + 0.25, 0).union(to_cells(plane(8, 8, 0, 0, 1.0) + 1, 1)).union(to_cells(plane(8, 8, 0, 0, 1.0), 2))
    ref = to_cells(plane(40, 36, -3, 4, 0.5), 0).union(to_cells(plane(8, 8, 0, 0, 1.0), 1)).union(to_cells(plane(9, 8, 0, 0, 1.0), 2))
    meta = spark.createDataFrame([(i, "m") for i in range(3)], "scene bigint, units string")
    grids = meta.where("scene = 0").select("scene", affine(0.5, -3.0, -0.5, 4.0).alias("src"), affine(1.0, 0.0, -1.0, 0.0).alias("dst"))
    report, layers = jobs.validate(pred, ref, meta, pred.limit(0), grids)
    got = {r.scene: r for r in report.collect()}
    assert got[0].n_pixels == 120 and abs(got[0].bias - 0.25) < 1e-9 and abs(got[0].rmse - 0.25) < 1e-9 and got[0].error is None
    assert got[1].n_pixels == 64 and abs(got[1].bias - 1) < 1e-9 and got[1].error is None
    assert got[2].rmse is None and "another size" in got[2].error
    assert {r.scene: r.n for r in layers.groupBy("scene").agg(F.count("error").alias("n")).collect()} == {0: 120, 1: 64}


def test_evaluate_scores_relative_tiles(spark, to_cells):
    rng = np.random.default_rng(0)
    heights = rng.normal(50, 5, (8, 16))
    refs = to_cells(heights, 0).union(to_cells(np.where(np.arange(16) < 8, heights, np.nan), 1))
    wide = to_cells(heights + 1, 0).select("scene", "row", "col", F.col("v").alias("dem"), F.col("v").alias("method_a"), F.col("v").alias("method_b"))
    dtms = to_cells(heights * 0, 0)
    tiles = spark.createDataFrame(
        [(0, 1, 0, 7, 0, 15, "metric"), (1, 2, 0, 7, 0, 7, "relative"), (1, 3, 0, 7, 8, 15, "relative"), (0, 4, 0, 7, 0, 15, None)],
        "scene bigint, tile int, row0 int, row1 int, col0 int, col1 int, mode string")
    scenes = spark.createDataFrame([(0, "hills"), (1, "urban")], "scene bigint, landscape string")
    cal = spark.createDataFrame([(0, "dem_band", 1.0)], "scene bigint, method string, scale double")
    rows = jobs.evaluate(wide, refs, dtms, tiles, scenes, cal, cal, relative=to_cells((heights - 40) / 20, 1))
    got = {(r.tile, r.method): r for r in rows.collect()}
    assert set(got) == {(1, "dem_only"), (1, "method_a"), (1, "method_b"), (2, "relative"), (3, "relative")}
    r = got[2, "relative"]
    assert r.n_pixels == 64 and r.rmse < 1e-9 and abs(r.scale - 20) < 1e-9 and r.cal_source == "scale-aligned" and r.landscape == "urban"
    assert got[3, "relative"].n_pixels == 0 and got[3, "relative"].rmse is None and abs(got[1, "dem_only"].bias - 1) < 1e-9
    summary, _, relative = jobs.evaluate_summary(rows)
    assert {x.method for x in summary.collect()} == {"dem_only", "method_a", "method_b"}
    assert [(x.tiles, x.scale_aligned) for x in relative.collect()] == [(2, True)]
    with pytest.raises(ValueError):
        jobs.evaluate(wide, refs, dtms, tiles, scenes, cal, cal)


def test_validate_tells_a_reference_that_misses(spark, to_cells):
    """A reference beside the result is another error than one with too few common cells."""
    pred = to_cells(plane(6, 6, 0, 0, 1.0), 0).union(to_cells(np.where(np.arange(36).reshape(6, 6) == 0, 5.0, np.nan), 1)).union(to_cells(plane(6, 6, 0, 0, 1.0), 2))
    ref = to_cells(plane(6, 6, 500, 0, 1.0), 0).union(to_cells(plane(6, 6, 0, 0, 1.0), 1)).union(to_cells(np.full((6, 6), np.nan), 2))
    meta = spark.createDataFrame([(i, "m") for i in range(3)], "scene bigint, units string")
    grids = meta.where("scene = 0").select("scene", affine(1.0, 500.0, -1.0, 0.0).alias("src"), affine(1.0, 0.0, -1.0, 0.0).alias("dst"))
    report, _ = jobs.validate(pred, ref, meta, pred.limit(0), grids)
    got = {r.scene: r.error for r in report.collect()}
    assert "beside" in got[0] and "too few" in got[1] and "beside" in got[2]


def test_calibrate_masks_and_undulation(spark, to_cells):
    """Cells without a picture are missing and move no percentile; a scaled undulation lowers ellipsoidal heights."""
    d = np.add.outer(np.arange(16.0), np.arange(16.0))
    d[0, 0] = 1e6
    cells = to_cells(d, 0).union(to_cells(d, 1))
    dem = to_cells(np.full((4, 4), 1000.0), 0).select("scene", "row", "col", "v", F.lit("a").alias("layer"), F.lit(1).alias("priority"))
    scenes = spark.createDataFrame([(i, 16, 16, 1.0, 4.0, "cartodem", 0.01, 3.0) for i in (0, 1)], "scene bigint, h int, w int, pixel_m double, dem_res_m double, source string, n_scale double, n_offset double")
    target = scenes.select("scene", "h", "w", affine(4.0, 0.0, -4.0, 0.0).alias("src"), affine(1.0, 0.0, -1.0, 0.0).alias("dst"))
    n = to_cells(np.full((16, 16), -4380.0), 0)
    invalid = cells.where("row = 0 AND col = 0").select("scene", "row", "col")
    out, records = jobs.calibrate(cells, scenes, dem, target, undulation=n, kernel="nearest", invalid=invalid)
    got = {(r.scene, r.row, r.col): r.v for r in out.collect()}
    assert got[0, 0, 0] is None and got[1, 0, 0] is None
    assert abs(got[0, 8, 8] - (1000.0 + 43.8 - 3.0)) < 1e-6
    assert got[1, 15, 15] == 1.0 and 0.4 < got[1, 7, 8] < 0.6  # the masked peak would press the others to 0
    assert {r.scene: r.mode for r in records.collect()} == {0: "absolute", 1: "relative"}


def test_control_points_find_their_pixels(spark):
    """Metres and degrees of the same places give the same pixels; points outside are dropped."""
    from altigrid.functions import geo

    scenes = spark.createDataFrame([(0, 100, 80, 32645), (1, 100, 80, 4326)], "scene bigint, h int, w int, epsg int")
    t = F.when(F.col("scene") == 0, affine(2.0, 500000.0, -2.0, 3000000.0)).otherwise(affine(0.001, 88.0, -0.001, 27.0))
    scenes = scenes.withColumn("t", t)
    want = {(0, 1): (10.5, 20.25), (0, 2): (99.5, 0.5), (1, 3): (50.0, 40.0)}
    px = spark.createDataFrame([(s, p, float(r), float(c)) for (s, p), (r, c) in want.items()] + [(0, 9, 100.5, 3.0)], "scene bigint, point int, r double, c double")
    world = px.join(scenes, "scene").withColumn("_w", geo.pixel_to_world(F.col("t"), "c", "r")).select("scene", "point", "epsg", F.col("_w.x").alias("x"), F.col("_w.y").alias("y"))
    degrees = geo.add_lonlat(world, "x", "y", "epsg", "lo", "la").select("scene", "point", F.when(F.col("epsg") == 4326, F.col("x")).otherwise(F.col("lo")).alias("lon"), F.when(F.col("epsg") == 4326, F.col("y")).otherwise(F.col("la")).alias("lat"))
    for points in (world.select("scene", "point", "x", "y"), degrees):
        got = {(r.scene, r.point): (r.row_f, r.col_f) for r in geo.place_points(points, scenes).collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-4 for k in want for a, b in zip(got[k], want[k]))


@pytest.mark.parametrize("few", [20_000, 0])
def test_build_site_builds_a_place_once(spark, monkeypatch, few):
    """Sites of one box share their cells; every site gets the tiles, by the items of the newest year that meets it."""
    import datetime

    from altigrid.operators import joins
    from altigrid.operators.resample import grid_frame

    monkeypatch.setattr(joins, "FEW_SITES", few)  # few sites may be broadcast, many are merged

    boxes = [(0.2, 0.2, 1.4, 0.9), (10.0, -5.5, 11.0, -4.5), (40.0, 40.0, 41.0, 41.0)]
    sites = spark.createDataFrame([(i, *boxes[i % 3], 8, 8) for i in range(31)] + [(5, *boxes[2], 8, 8), (99, None, None, None, None, 8, 8)], "scene bigint, west double, south double, east double, north double, h int, w int")
    at = [(0.0, 0.0, 0.5, 0.5), (10.5, -5.0, 12.0, -4.0)]
    items = [(i, datetime.datetime(2000 + i % 4, 5, 1) if i else None, *at[i // 4 % 2]) for i in range(16)]
    seen = []

    def cells(matched):
        return grid_frame(matched.withColumn("h", F.lit(8)).withColumn("w", F.lit(8)))

    def image(matched):
        seen.append(sorted((r.scene, r.item) for r in matched.collect()))
        return cells(matched).select("scene", "row", "col", "_place", "item", F.col("item").alias("priority"), F.lit(1).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))

    def heights(matched):
        v = F.when((F.col("row") < 4) | (F.col("item") % 8 > 4), F.col("item") * 1.0)
        return cells(matched).select("scene", "row", "col", "_place", F.col("item").alias("layer"), F.col("item").alias("priority"), v.alias("v"))

    items = spark.createDataFrame(items, "item bigint, ts timestamp, west double, south double, east double, north double")
    got = sorted(tuple(r) for r in jobs.build_site(items, sites, image, heights, heights, 4, 0.5).select("scene", "r", "c", "valid_frac").collect())
    assert seen == [[(0, 3), (0, 11), (1, 7), (1, 15)]]
    assert got == sorted((s, r, c, 1.0) for s in range(31) for r in range(2) for c in range(2) if s % 3 == 1 or s % 3 == 0 and r == 0)


def test_mosaics_of_numbered_layers_need_no_join(spark):
    """Layers numbered while they had a row each give the same mosaics; their cells are neither joined nor shuffled again."""
    from altigrid.operators import joins
    from altigrid.operators.resample import grid_frame

    k = F.col("id")
    layers = spark.range(60).select((k % 4).alias("scene"), k.cast("string").alias("item"), F.when(k % 7 != 3, k * 5 % 6).alias("priority"), F.lit(5).alias("h"), F.lit(6).alias("w"))
    code = F.hash("scene", "item", "row", "col")

    def cells(dims):
        kept = [c for c in dims.columns if c == "_place"]
        return grid_frame(dims).select("scene", "row", "col", *kept, "item", "priority", F.when(code % 3 == 0, code * 1.0).alias("v"), *[F.when(code % 5 == i, code % 90).otherwise(0).alias(c) for i, c in enumerate("rgb")])

    def rows(df):
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))

    plain, placed = cells(layers), cells(joins.number_layers(layers, "priority", "item"))
    assert rows(joins.mosaic(plain, tie="item")) == rows(joins.mosaic(placed, tie="item"))
    for a, b in zip(joins.mosaic_images(plain, 0.5), joins.mosaic_images(placed, 0.5), strict=True):
        assert rows(a) == rows(b) != []
    best = joins.mosaic(placed.withColumn("item", F.col("item").cast("int")), tie="item")
    text = best._sc._jvm.PythonSQLUtils.explainString(best._jdf.queryExecution(), "simple")
    final = text.split("== Initial Plan ==")[0]
    assert "Join" not in final and "SortAggregate" not in final and "hashpartitioning(scene#" in final and "row#" in final.split("hashpartitioning(")[1].split(")")[0]
    assert not any("col#" in p.split(")")[0] for p in final.split("hashpartitioning(")[1:])
