"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Two groups. ``queries`` are checked queries over the given tables. ``grid_16m`` are the published
single-machine workloads (range scan, reference compare, display grid, 2,048-point profile) on a
4000 x 4000 pair of grids: the same cells for all of them, derived from the given height grid and
stored once before timing.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "flagship_landscape_scores", "e01_dsm_metrics_pairs", "e02_compare", "e03_finite_range", "e04_relative_metrics",
    "e07_huber_affine_pairs", "e13_trimmed_alignment", "e14_weighted_blend", "e17_landscape_summary", "e22_flooded_share",
    "f01_finite_differences", "f02_gaussian_blur", "f04_nearest_fill", "c14_slope", "c02_stretch_8bit", "d02_window_range_join",
    "d04_footprint_join", "d06_priority_mosaic", "r01_resample_bilinear", "r03_area_downsample", "r07_transect_profile",
    "r08_mesh_vertices", "h01_worst_tiles", "h03_parameter_sweep", "u01_tile_predictor", "v1_calibrate", "v2_evaluate_tiles",
]
SIDE = 4000


def timed(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def big_grids(spark: SparkSession, sf_dir: str, path: str):
    """A 4000 x 4000 scene tiled from the G1 cells: its cells, and the scene and its reference as two stored grids."""
    from altigrid.queries import fixtures as fx
    from altigrid.sources import strips

    cells = fx.g1(spark, sf_dir).where("scene = 0").select("row", "col", "v")
    across = F.explode(F.sequence(F.lit(0), F.lit(SIDE // 64)))
    down = F.explode(F.sequence(F.lit(0), F.lit(SIDE // 50 - 1)))
    g = cells.withColumn("_j", across).withColumn("_i", down).repartition(64, "_i")
    g = g.select(
        F.lit(0).cast("bigint").alias("scene"), (F.col("row") + 50 * F.col("_i")).cast("int").alias("row"),
        (F.col("col") + 64 * F.col("_j")).cast("int").alias("col"), (F.col("v") + F.col("_i") * 0.25).alias("v"),
    ).where(F.col("col") < SIDE)
    g.write.parquet(f"{path}/pred")
    g = spark.read.parquet(f"{path}/pred")
    n = strips.bucket_count(g)
    return g, strips.store_grid(g, "pred", n), strips.store_grid(g.withColumn("v", F.col("v") - 2.0), "ref", n)


def grid_16m(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    from altigrid.operators import joins, metrics, resample

    cells, pred, ref = big_grids(spark, sf_dir, os.path.join(tempfile.mkdtemp(prefix="spark-"), "grid"))
    sc = spark.range(1).select(F.col("id").alias("scene"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.lit(1.0).alias("pixel_m"), F.lit(0.0).alias("min_h"))
    line = spark.range(1).select(
        F.col("id").alias("scene"), F.lit(0).alias("line"), F.lit(0.0).alias("c0"), F.lit(0.0).alias("r0"), F.lit(2047.0).alias("c1"), F.lit(0.0).alias("r1"))
    jobs = {
        "range_scan": lambda: metrics.finite_range(cells, ["scene"]),
        "compare": lambda: metrics.compare(joins.join_cells(pred, ref), "pred", "ref", ["scene"]),
        "dsm_metrics": lambda: metrics.dsm_metrics(joins.join_cells(pred, ref), "pred", "ref", ["scene"]),
        "display_grid_513": lambda: resample.mesh(cells, sc, 513)[0],
        "profile_2048": lambda: resample.profile(cells, line),
    }
    out = {}
    for name, job in jobs.items():
        timed(job())
        out[name] = round(timed(job()), 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("altigrid-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from altigrid.queries import load_all
    from altigrid.queries.registry import QUERIES

    load_all()
    timed(QUERIES["e02_compare"](spark, sf_dir))  # start-up and code generation are not the subject
    only = sys.argv[1:]
    queries = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - t0, 3)
    grid = {} if only and "grid" not in only else grid_16m(spark, sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
        "grid_16m": grid, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
