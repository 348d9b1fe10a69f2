"""What joins of cells and of per-scene values do at size, seen in their plans, and scenes that lack their last rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from altigrid import model
from altigrid.model import attach, meet
from altigrid.functions.tiles import tile_weight
from altigrid.operators import neighbourhood, ranks, resample, tiling

BASE = "/root/testdata/sf0.001"
LAID_OUT = ["c13_taper_weights", "d03_overlap_explode", "e13_trimmed_alignment", "e14_weighted_blend", "e15_seam_ratio", "u01_tile_predictor"]


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_attach_takes_the_scene_side_once(spark):
    cells = spark.range(1000).select((F.col("id") % 7).alias("scene"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    dims = spark.range(7).select(F.col("id").alias("scene"), F.lit(1).alias("h"))
    assert "Generate" not in plan_of(attach(cells, dims))
    assert attach(cells, dims).count() == 1000
    assert attach(cells, dims.where("scene < 3")).count() == attach(cells, dims.where("scene < 3"), how="left_semi").count() == 429


def test_cells_are_never_broadcast(spark):
    a = spark.range(100).select(F.lit(0).alias("scene"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("v"))
    for how in ("inner", "left"):
        both = meet(a, a.withColumnRenamed("v", "u"), how=how)
        assert "SortMergeJoin" in plan_of(both) and "BroadcastHashJoin" not in plan_of(both)
        assert both.count() == 100


@pytest.fixture(scope="module")
def cut_short(tmp_path_factory):
    """Vectors for a whole scene and one of 36 rows, as tables of a size that 50 does not divide give them."""
    out = tmp_path_factory.mktemp("short")
    duckdb.sql(f"COPY (SELECT * FROM '{BASE}/embeddings.parquet' WHERE vec_id < 86) TO '{out}/embeddings.parquet'")
    return str(out)


@pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are not here")
@pytest.mark.parametrize("name", LAID_OUT)
def test_scene_without_its_last_rows_matches_sql(spark, cut_short, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{cut_short}/embeddings.parquet'")
    df = entry.queries()[name](spark, cut_short)
    found = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in found.description]

    def rows(names, records):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(repr(r[i]) for i in order) for r in records)

    assert rows(df.columns, df.collect()) == rows(cols, found.fetchall())


def test_tile_sums_are_taken_from_the_last_tile_to_the_first(spark):
    """A sum's last bits depend on its order; the SQL takes the last column of tiles first."""
    cells = spark.range(50 * 64).select(
        F.lit(0).cast("bigint").alias("scene"), F.expr("int(id div 64)").alias("row"), F.expr("int(id % 64)").alias("col"), (100 + 50 * F.sin(F.col("id") * 1.7)).alias("v"))
    size = spark.createDataFrame([(0, 50, 64)], "scene long, h int, w int")
    x = tiling.explode_overlaps(cells, size, 16, 8).withColumn("t", (F.col("v") - F.col("y0") + F.col("x0")) / (1 + (F.col("y0") + F.col("x0")) / 40))
    x = x.withColumn("_w", tile_weight("row", "col", "y0", "x0", 16, "h", "w"))
    top, weight = {}, {}
    for r in sorted(x.collect(), key=lambda r: (-r.x0, -r.y0)):
        top[r.row, r.col] = top.get((r.row, r.col), 0.0) + r._w * r.t
        weight[r.row, r.col] = weight.get((r.row, r.col), 0.0) + r._w
    got = {(r.row, r.col): r.v for r in tiling.blend(x, "t", "_w").collect()}
    assert got == {k: top[k] / weight[k] for k in top}


def test_degree_grids_beyond_the_zones_or_a_turn(spark):
    def scene(n, west, north):
        return (n, 4, 5, "EPSG:4326", 4326, (0.001, 0.0, west, 0.0, -0.001, north))

    places = [scene(0, 20.0, 45.0), scene(1, 380.0, 45.0), scene(2, -700.0, 45.0), scene(3, 20.0, 90.0), scene(4, 20.0, 155.0), scene(5, 20.0, -84.0)]
    shape = "scene long, h int, w int, crs string, epsg int, t struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    scenes = spark.createDataFrame(places, shape)
    cells = spark.range(6).select(F.col("id").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    cells = cells.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("v", F.col("row") * 10.0 + F.col("col"))
    out, meta = resample.reproject_to_utm(cells, scenes)
    found = {r.scene: r for r in meta.collect()}
    got = {n: sorted((r.row, r.col, None if r.v is None else round(r.v, 6), r.valid) for r in out.where(f"scene = {n}").collect()) for n in range(6)}
    assert found[0].epsg == found[1].epsg == found[2].epsg == 32634
    assert len(got[0]) == found[0].h * found[0].w and sum(x[3] for x in got[0]) >= 10
    assert got[0] == got[1] == got[2]  # whole turns away, the same ground
    for n in (3, 4, 5):  # no zone: unchanged
        assert found[n].epsg == 4326 and (found[n].h, found[n].w) == (4, 5)
        assert got[n] == [(r, c, r * 10.0 + c, True) for r in range(4) for c in range(5)]


def test_cells_keep_many_partitions(spark):
    """Coalesced by their size in a shuffle, a core would get one partition, however many cells that makes."""
    want = 4 * spark.sparkContext.defaultParallelism
    a = spark.range(20_000).select((F.col("id") % 5).alias("scene"), F.expr("int(id div 500)").alias("row"), F.expr("int(id div 5 % 100)").alias("col"), F.lit(1.0).alias("v"))
    assert meet(a, a.withColumnRenamed("v", "u")).rdd.getNumPartitions() >= want
    assert neighbourhood.blocked(a, 1, 1).rdd.getNumPartitions() >= want


def test_rows_of_quantiles_are_dealt_out(spark):
    a = spark.range(20_000).select((F.col("id") % 500).alias("scene"), F.col("id").cast("double").alias("v"))
    for wanted in ({"q": ("v", 0.5)}, {"q": ("v", 0.5), "p": (F.col("v") * 2, 0.25)}):
        out = ranks.quantiles(a, ["scene"], wanted)
        assert f"{model.cell_parts(spark)}), REPARTITION_BY_NUM" in plan_of(out)
        assert {r.scene: r.q for r in out.collect()} == {s: s + 500 * 19.5 for s in range(500)}


def test_points_of_a_cell_share_its_stencil(spark, to_cells, monkeypatch):
    """What is stored and looked up follows the cells that points touch, not the points."""
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(6, 7))
    grid[2, 3] = np.nan
    ref = grid * 2 + 1
    at = np.concatenate([rng.uniform(-0.5, 6.9, (400, 2)), [[5, 6], [0, 0], [5, 2.5], [2, 3], [1.5, 2.5]]])
    points = spark.createDataFrame([(i, 0, float(r), float(c)) for i, (r, c) in enumerate(at)], "point int, scene bigint, row_f double, col_f double")
    stored = []
    keep = resample.cut_measured
    monkeypatch.setattr(resample, "cut_measured", lambda df, *m: stored.append(keep(df, *m)) or stored[-1])
    got = {r.point: r for r in resample.inspect(to_cells(grid), points, to_cells(ref)).collect()}
    assert len(stored) == 1 and stored[0][0].count() <= 12 * 8 * 9
    assert len(got) == len(at)

    def value(g, r, c):
        r0, c0 = int(np.floor(r)), int(np.floor(c))
        if not (0 <= r0 < 6 and 0 <= c0 < 7):
            return None
        total = 0.0
        for i, wr in ((r0, 1 - (r - r0)), (r0 + 1, r - r0)):
            for j, wc in ((c0, 1 - (c - c0)), (c0 + 1, c - c0)):
                if wr * wc > resample.WEIGHT_FLOOR:
                    if not (i < 6 and j < 7) or np.isnan(g[i, j]):
                        return None
                    total += wr * wc * g[i, j]
        return total

    for i, (r, c) in enumerate(at):
        want, other = value(grid, r, c), value(ref, r, c)
        assert (got[i].height is None) == (want is None), (r, c)
        if want is None:
            assert got[i].slope is None and got[i].error is None
            continue
        assert abs(got[i].height - want) < 1e-9 and abs(got[i].error - (want - other)) < 1e-9
        a, b = int(np.floor(r + 0.5)), int(np.floor(c + 0.5))
        w, e, n, s = grid[a, max(b - 1, 0)], grid[a, min(b + 1, 6)], grid[max(a - 1, 0), b], grid[min(a + 1, 5), b]
        gx, gy = (e - w) / (min(b + 1, 6) - max(b - 1, 0)), (s - n) / (min(a + 1, 5) - max(a - 1, 0))
        slope = None if np.isnan(gx + gy) else np.degrees(np.arctan(np.hypot(gx, gy)))
        assert (got[i].slope is None) == (slope is None) and (slope is None or abs(got[i].slope - slope) < 1e-9), (r, c)


def test_footprint_pairs_come_cell_by_cell(spark):
    """Items of a degree cell come together, each with the same sites in the same order, so that the pairs are stored in little room."""
    from altigrid.operators import joins

    k = F.col("id")
    box = lambda i: [(i * 7 % 5 * 10.0 + 0.25).alias("west"), F.lit(0.25).alias("south"), (i * 7 % 5 * 10.0 + 0.75).alias("east"), F.lit(0.75).alias("north")]
    got = joins.join_footprints(spark.range(200).select(k.alias("item"), *box(k)), spark.range(100).select(k.alias("site"), *box(k)))
    assert "SortMergeJoin" in plan_of(got) and "BroadcastHashJoin" not in plan_of(got)
    rows = [(r.item, r.site) for r in got.select("item", "site").collect()]
    assert sorted(rows) == [(i, j) for i in range(200) for j in range(100) if i % 5 == j % 5]
    cells = [i % 5 for i, _ in rows]
    assert sum(a != b for a, b in zip(cells, cells[1:])) == 4
    assert len({tuple(j for i, j in rows if i == x) for x in range(200)}) == 5


def test_settings_of_one_objective_rank_by_their_number(spark):
    """Sums of the same values in another order differ in their last bits; such settings tie."""
    from altigrid.operators import evaluation as ev

    values = [0.1 + 0.2, 0.3, 0.2, 0.3 - 2e-16]
    rows = [(i, "nearest", 1.0, 4.0, float(i), 1e9, 0.0, 0, 0, "urban", "dem_only", v, v, 1.0) for i, v in enumerate(values)]
    names = "setting mode band_sigma_k band_coarse_cells band_min_r dem_relief_std_m prior_height_m scene tile landscape source rmse rmse_objects rmse_dem_only".split()
    out = ev.rank_sweep(spark.createDataFrame(rows, names), {"band_min_r": 1.0}, 4)
    assert [(r.rank, r.setting) for r in out.where("kind = 'ranked'").orderBy("rank").collect()] == [(1, 2), (2, 0), (3, 1), (4, 3)]
    assert [(r.rank, r.setting) for r in out.where("kind = 'current'").collect()] == [(3, 1)]
