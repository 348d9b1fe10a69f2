"""Grids with known truth: gradients, samples, profiles, display grids, fills, blurs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from altigrid.operators import metrics, resample, surface
from altigrid.operators.blur import gaussian
from altigrid.operators.neighbourhood import differences, fill_nearest
from altigrid.sources.grids import synthetic_grid

PX = 2.0


@pytest.fixture(scope="module")
def plane():
    r, c = np.mgrid[0:4, 0:5]
    return 100.0 + 2 * c + 4 * r


def points(spark, *pairs):
    return spark.createDataFrame([(0, float(c), float(r)) for c, r in pairs], "scene bigint, col_f double, row_f double")


def test_plane_range_gradient_and_slope(to_cells, plane):
    cells = to_cells(plane)
    rng = metrics.finite_range(cells, ["scene"]).first()
    assert (rng.min_h, rng.max_h, rng["count"], rng.error) == (100, 120, 20, None)
    s = surface.slope(cells, PX).select("gx", "gy", "slope_deg").distinct().collect()
    assert all(abs(x.gx - 1) < 1e-9 and abs(x.gy - 2) < 1e-9 for x in s)
    assert all(abs(x.slope_deg - math.degrees(math.atan(math.sqrt(5)))) < 1e-6 for x in s)


def test_samples_and_missing_neighbours(spark, to_cells, plane):
    got = resample.bilinear(to_cells(plane), points(spark, (1.5, 2.5), (4, 3), (4.01, 0), (-0.1, 1))).collect()
    by = {(p.col_f, p.row_f): p.height for p in got}
    assert by[(1.5, 2.5)] == pytest.approx(113) and by[(4, 3)] == pytest.approx(120)
    assert by[(4.01, 0)] is None and by[(-0.1, 1)] is None
    hole = plane.copy()
    hole[1, 1] = np.nan
    got = resample.inspect(to_cells(hole), points(spark, (1, 1), (0.5, 0.5), (0, 0), (2, 1)), px=PX).collect()
    by = {(p.col_f, p.row_f): p for p in got}
    assert by[(1, 1)].height is None and by[(0.5, 0.5)].height is None and by[(0, 0)].height == 100
    assert by[(2, 1)].height == 108 and by[(2, 1)].slope is None  # its west neighbour is missing


def test_compare_with_offset_reference(to_cells, plane):
    ref = plane - 2
    ref[0, 3] = np.nan
    pairs = to_cells(plane, name="pred").join(to_cells(ref, name="ref"), ["scene", "row", "col"])
    m = metrics.compare(pairs, "pred", "ref", ["scene"]).first()
    assert (m.rmse, m.mae, m.bias, m["count"], m.max_abs) == (2, 2, 2, 19, 2)


def test_profile_ends_and_length(spark, to_cells, plane):
    line = spark.createDataFrame([(0, 0, 0.0, 0.0, 4.0, 3.0)], "scene bigint, line int, c0 double, r0 double, c1 double, r1 double")
    p = resample.profile(to_cells(plane), line, PX).orderBy("i").collect()
    assert len(p) == 6 and p[0].height == 100 and p[-1].height == pytest.approx(120) and p[-1].distance == pytest.approx(10)
    s = resample.profile_stats(resample.profile(to_cells(plane), line, PX)).first()
    assert s.net_change == pytest.approx(20) and s.length == pytest.approx(10)


def test_wide_strip_display_grid(spark, to_cells):
    g = np.full((7, 1300), 110.0)
    g[0, 0] = np.nan
    sc = spark.createDataFrame([(0, 7, 1300, 2.0, 110.0)], "scene bigint, h int, w int, pixel_m double, min_h double")
    v, t = resample.mesh(to_cells(g), sc, 5000)
    assert v.agg(F.max("c")).first()[0] == 1023 and v.where("NOT valid").count() == 1
    assert t.where("i0 = 0 OR i1 = 0 OR i2 = 0").count() == 0
    rows = v.agg(F.max("r")).first()[0] + 1
    assert t.count() == (rows - 1) * 1023 * 2 - 1  # only the triangle at the missing corner is gone


def test_cone_peak_and_flank(spark):
    cone = synthetic_grid(spark, "cone")
    peak = cone.orderBy(F.desc("v")).first()
    assert (peak.row, peak.col, peak.v) == (512, 512, 100.0) and (peak.r, peak.g, peak.b) == (220, 30, 30)
    flank = cone.where("row = 512 AND col IN (710, 712)").orderBy("col").collect()
    assert math.degrees(math.atan(abs(flank[1].v - flank[0].v) / 2)) == pytest.approx(14.04, abs=0.1)
    assert cone.where("row = 8 AND col = 512").first().b == 230


def test_corner_is_north_west(spark):
    from altigrid.functions.terrain import local_xz

    n = F.lit(513.0)
    raised = synthetic_grid(spark, "corner").where("v > 0").select(local_xz("row", "col", n, n, F.lit(1.0)).alias("p"))
    mean = raised.agg(F.avg("p.x").alias("x"), F.avg("p.z").alias("z")).first()
    assert mean.x < 0 and mean.z < 0


def test_differences_across_blocks(to_cells, to_grid):
    rng = np.random.default_rng(0)
    g = rng.normal(size=(37, 45))
    d = differences(to_cells(g), 2.0, block=8)
    assert d.count() == g.size
    gy, gx = np.gradient(g, 2.0)
    assert np.allclose(to_grid(d, "gx"), gx) and np.allclose(to_grid(d, "gy"), gy)


def mirror_blur(g, sigma):
    radius = math.ceil(4 * sigma)
    k = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(g, radius, mode="symmetric")
    p = np.apply_along_axis(lambda a: np.convolve(a, k, "valid"), 0, p)
    return np.apply_along_axis(lambda a: np.convolve(a, k, "valid"), 1, p)


def test_blur_across_blocks_matches_direct(to_cells, to_grid):
    g = np.random.default_rng(1).normal(size=(300, 270))
    assert np.allclose(to_grid(gaussian(to_cells(g), 2.5)), mirror_blur(g, 2.5))
    small = g[:6, :9]  # the kernel is wider than the grid
    assert np.allclose(to_grid(gaussian(to_cells(small), 3.0)), mirror_blur(small, 3.0))


def test_wide_blur_is_close_to_direct(to_cells, to_grid):
    g = mirror_blur(np.random.default_rng(0).normal(size=(400, 400)), 3)
    direct, fast = mirror_blur(g, 20), to_grid(gaussian(to_cells(g), 20))
    inner = (slice(50, -50), slice(50, -50))
    assert np.sqrt(np.mean((direct[inner] - fast[inner]) ** 2)) < 0.1 * direct.std()


def test_blur_sigma_per_scene(spark, to_cells, to_grid):
    g = np.random.default_rng(2).normal(size=(40, 40))
    both = to_cells(g, 0).withColumn("s", F.lit(2.0)).unionByName(to_cells(g, 1).withColumn("s", F.lit(9.0)))
    out = gaussian(both, "s")
    assert np.allclose(to_grid(out.where("scene = 0")), mirror_blur(g, 2.0))
    assert np.allclose(to_grid(out.where("scene = 1")), to_grid(gaussian(to_cells(g), 9.0)))


@pytest.mark.parametrize("share", [0.3, 0.97])
def test_fill_nearest_against_brute_force(to_cells, to_grid, share):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(23, 31))
    g[rng.random(g.shape) < share] = np.nan
    g[5:15, 8:20] = np.nan
    valid = np.argwhere(np.isfinite(g))
    want = g.copy()
    for r, c in np.argwhere(np.isnan(g)):
        d = (valid[:, 0] - r) ** 2 + (valid[:, 1] - c) ** 2
        best = valid[np.lexsort((valid[:, 1], valid[:, 0], d))[0]]
        want[r, c] = g[tuple(best)]
    out = fill_nearest(to_cells(g))
    assert np.array_equal(to_grid(out), want)
    assert out.where("filled").count() == np.isnan(g).sum()


def test_fill_leaves_an_empty_scene_alone(to_cells):
    out = fill_nearest(to_cells(np.full((3, 4), np.nan)))
    assert out.where("v IS NOT NULL OR filled").count() == 0 and out.count() == 12


def test_flooded_share_on_another_surface(to_cells):
    g = np.arange(100.0).reshape(10, 10)
    out = {r.step: r for r in surface.flooded_share(to_cells(g), 500, to_cells(g + 50)).collect()}
    assert out[500].share == pytest.approx(np.mean(g + 50 < out[500].level))
    assert out[400].share == pytest.approx(np.mean(g + 50 < out[400].level))


def test_reproject_keeps_metric_grids(spark, to_cells):
    t = "struct(1.0D as a, 0.0D as b, 500000.0D as c, 0.0D as d, -1.0D as e, 4000000.0D as f)"
    sc = spark.sql(f"select 0L as scene, 4 as h, 5 as w, 'EPSG:32613' as crs, 32613 as epsg, {t} as t")
    out, meta = resample.reproject_to_utm(to_cells(np.ones((4, 5))), sc)
    assert out.count() == 20 and out.where("valid").count() == 20 and meta.first().w == 5


def test_reproject_degree_grid(spark, to_cells):
    t = "struct(0.0001D as a, 0.0D as b, -105.003D as c, 0.0D as d, -0.0001D as e, 40.002D as f)"
    sc = spark.sql(f"select 0L as scene, 40 as h, 60 as w, 'EPSG:4326' as crs, 4326 as epsg, {t} as t")
    g = np.tile(np.arange(60.0), (40, 1))  # rises eastwards
    out, meta = resample.reproject_to_utm(to_cells(g), sc)
    m = meta.first()
    assert m.epsg == 32613 and m.t.a == pytest.approx(8.54, abs=0.02)  # finer side: longitude at 40 N
    assert m.h == pytest.approx(40 * 11.1 / 8.54, abs=2) and m.w == pytest.approx(60, abs=2)
    mid = out.where(f"row = {m.h // 2}").orderBy("col").collect()
    v = [p.v for p in mid if p.v is not None]
    assert len(v) >= 56 and np.allclose(np.diff(v), 1.0, atol=0.02)
    assert out.where("valid").count() > 0.9 * m.h * m.w


def test_control_points_beside_gaps(spark, to_cells):
    """A point on a centre needs all four cells around it, as one between centres does; the last centre counts."""
    from altigrid.operators import resample

    grid = np.arange(20, dtype=float).reshape(4, 5)
    grid[1, 2] = np.nan
    spots = {0: (1.5, 1.5, None), 1: (0.5, 1.5, None), 2: (2.5, 2.5, 12.0), 3: (3.5, 4.5, 19.0), 4: (3.8, 2.5, None), 5: (2.5, 3.0, 12.5), 6: (1.5, 3.5, 8.0), 7: (9.0, 9.0, "out")}
    points = spark.createDataFrame([(k, 0, r, c) for k, (r, c, _) in spots.items()], "point int, scene bigint, row_f double, col_f double")
    got = {r.point: r.value for r in resample.sample_points(to_cells(grid), points).collect()}
    assert got == {k: v for k, (_, _, v) in spots.items() if v != "out"}


def test_stored_grids_meet_without_a_shuffle(spark, to_cells):
    """D1, D9, D13, D14 on stored strips give what they give on cells, gaps and wide rows included; no exchange under the join."""
    from altigrid.operators import joins
    from altigrid.sources import strips

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(6, 2500)), rng.normal(size=(6, 2500))
    a[2, 1000:1100], b[5, 2499] = np.nan, np.nan
    ca, cb = to_cells(a), to_cells(b)
    sa, sb = strips.store_grid(ca, "a", 4), strips.store_grid(cb, "b", 4)
    same = lambda x, y: sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.select(x.columns).collect()), key=repr)
    assert same(strips.cells_of(sa), ca)
    # tables this small would be broadcast
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = joins.join_cells(sa, sb)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    met = joins.join_cells(sa, sb)
    assert same(met, joins.join_cells(ca, cb)) and same(joins.join_cells(sa, cb), joins.join_cells(ca, cb))
    assert same(joins.difference(sa, sb), joins.difference(ca, cb)) and same(joins.join_three(sa, sb, sa), joins.join_three(ca, cb, ca))
    mask = cb.where("v > 1")
    assert same(joins.apply_mask(sa, strips.store_grid(mask, "m", 4)), joins.apply_mask(ca, mask))


def test_display_mesh_of_any_shape(spark, to_cells):
    """Stencils found from the cells equal plain sampling at every vertex, for thin, small and wide grids."""
    from altigrid.operators import resample

    rng = np.random.default_rng(1)
    for shape, cap in (((1, 7), 4), ((7, 1), 5), ((5, 5), 5), ((40, 23), 9), ((23, 40), 40), ((2, 300), 17)):
        grid = rng.normal(size=shape)
        grid[rng.random(shape) < 0.1] = np.nan
        cells = to_cells(grid)
        scenes = spark.createDataFrame([(0, *shape, 2.0, -5.0)], "scene bigint, h int, w int, pixel_m double, min_h double")
        got, _ = resample.mesh(cells, scenes, cap, ref=cells)
        pts = got.select("scene", "vertex", (F.col("z") / 2.0 + (shape[0] - 1) / 2.0).alias("row_f"), (F.col("x") / 2.0 + (shape[1] - 1) / 2.0).alias("col_f"))
        want = {r.vertex: (r.height, r.slope) for r in resample.inspect(cells, pts.select("*", F.round("row_f", 9).alias("_r"), F.round("col_f", 9).alias("_c")).drop("row_f", "col_f").withColumnsRenamed({"_r": "row_f", "_c": "col_f"}), px=2.0).collect()}
        rows = got.collect()
        assert len(rows) == len(want) >= 4
        for r in rows:
            h, _ = want[r.vertex]
            assert r.valid == (h is not None) and (h is None or abs(r.y - 5.0 - h) < 1e-6)
            assert not r.error_valid or abs(r.error) < 1e-12


def test_fill_over_blocks_and_stretches(to_cells, to_grid):
    """Few sources on a grid of several row blocks and column stretches; ties to the smallest row, then column."""
    rng = np.random.default_rng(6)
    g = np.full((540, 560), np.nan)
    at = rng.integers(0, 540, 14), rng.integers(0, 560, 14)
    g[at] = np.arange(14.0) + 1
    g[10, 300], g[30, 300] = 77.0, 88.0  # equally near to row 20
    src = np.argwhere(np.isfinite(g))  # by row, then column
    r, c = np.mgrid[0:540, 0:560]
    cost = (r[..., None] - src[:, 0]) ** 2 + (c[..., None] - src[:, 1]) ** 2
    want = g[tuple(src[cost.argmin(axis=-1)].reshape(-1, 2).T)].reshape(g.shape)
    assert (to_grid(fill_nearest(to_cells(g))) == want).all()
