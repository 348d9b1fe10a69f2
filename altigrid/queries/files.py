"""Checked queries: file sources, sinks and streams. Files are written from the given tables first."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from altigrid.functions.numbers import rounded
from altigrid.model import CELL_SCHEMA, scratch_path
from altigrid.operators import evaluation as ev
from altigrid.queries import fixtures as fx
from altigrid.queries.joins import LAYERS, layers
from altigrid.queries.metrics import r6
from altigrid.queries.registry import query
from altigrid.queries.terrain import DIMS, area_sql
from altigrid.sources import files, listings, sinks
from altigrid.sources.grids import scan_grid
from altigrid.streaming import jobs as streams

KEY = ["scene", "row", "col"]


@query("a03_packed_scan", """
SELECT vec_id AS scene, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(1, 65) t(i)""")
def a03(spark, d):
    def pack(frames):
        for pdf in frames:
            yield pd.DataFrame({"scene": pdf["vec_id"], "content": [np.asarray(e, dtype="<f4").tobytes() for e in pdf["embedding"]]})

    e = fx.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "scene bigint, content binary")
    return r6(files.decode_packed(e.withColumn("width", F.lit(8)).withColumn("height", F.lit(8))), ["v"])


@query("a04_dem_tile_scan", fx.with_sql(fx.G1, LAYERS) + "SELECT scene, row, col, layer AS tile, CAST(priority AS INTEGER) AS priority, round(v, 6) + 0.0 AS v FROM ly")
def a04(spark, d):
    path = scratch_path(spark, "dem")
    cells = layers(fx.g1(spark, d)).select("scene", F.col("layer").alias("part"), "layer", "row", "col", "v")
    cells.write.partitionBy("part").parquet(path)
    out = files.scan_dem_tiles(spark, path, CELL_SCHEMA, tile_pattern=r"part=([^/]+)/")
    return r6(out.select(*KEY, "tile", "priority", "v"), ["v"])


@query("a05_control_point_scan", """
SELECT event_id % 7 AS scene, CAST(event_id AS DOUBLE) / 8 AS lon, CAST(user_id AS DOUBLE) / 4 AS lat, value AS height_m FROM events""")
def a05(spark, d):
    path = scratch_path(spark, "points")
    e = fx.table(spark, d, "events")
    e.select(
        (F.col("event_id") % 7).alias(" Scene"), (F.col("event_id") / 8.0).alias("Lon "), (F.col("user_id") / 4.0).alias(" LAT"), F.col("value").alias("Height_M")
    ).write.csv(path, header=True)
    return listings.scan_control_points(spark, path)


RESULT = """rs AS (SELECT event_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def result_texts(spark, d):
    """Metadata texts from events: every seventh damaged, every fifth without a name."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    name = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"source_name":"s'), k, F.lit('"')))
    good = F.concat(
        F.lit('{"width":'), (F.col("event_id") % 50).cast("string"), F.lit(',"height":'), k, F.lit(',"units":"'), F.when(F.col("event_id") % 3 == 0, "m").otherwise("relative"),
        F.lit('","pixel_size_m":0.5,"min_h":1.0,"max_h":'), (F.col("event_id") % 9).cast("string"), name, F.lit(',"calibration":{"method":"gcp","confidence":"high"}}'),
    )
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"width":'), k)).otherwise(good)
    return fx.table(spark, d, "events").select(F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("job_id"), text.alias("text"), F.col("ts").alias("finished"))


@query("a08_results_catalogue", fx.with_sql(RESULT) + """
SELECT 'job' || event_id AS job_id, CASE WHEN event_id % 5 = 0 THEN 'job' || event_id ELSE 's' || k END AS name, CASE WHEN event_id % 3 = 0 THEN 'm' ELSE 'relative' END AS units,
  event_id % 50 AS width, k AS height, 0.5::DOUBLE AS pixel_size_m, 'gcp' AS method, strftime(ts, '%Y-%m-%d %H:%M:%S') AS finished FROM rs WHERE event_id % 7 <> 0""")
def a08(spark, d):
    rows = files.catalogue_rows(result_texts(spark, d)).orderBy(F.desc("finished"))
    when = F.date_format("finished", "yyyy-MM-dd HH:mm:ss")
    return rows.select("job_id", "name", "units", "width", "height", "pixel_size_m", F.col("calibration.method").alias("method"), when.alias("finished"))


@query("a09_metadata_validation", fx.with_sql(RESULT) + """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not a JSON object' WHEN event_id % 50 < 2 THEN 'bad width' WHEN k < 2 THEN 'bad height'
  WHEN event_id % 9 < 1 THEN 'bad height range' WHEN event_id % 11 < 4 THEN 'crs is not a text' END AS error FROM rs""")
def a09(spark, d):
    t = result_texts(spark, d).withColumn("text", F.when(F.col("text").endswith("}"), F.col("text")).otherwise("[]"))
    # a number, a list, an object and a Boolean instead of a text; a null and a text are right
    crs = F.element_at(F.array(*[F.lit(x) for x in ("4326", '["EPSG:4326"]', '{"a":1}', "true", "null", '"EPSG:4326"')]), F.least(F.substring("job_id", 4, 20).cast("bigint") % 11 + 1, F.lit(6)).cast("int"))
    t = t.withColumn("text", F.when(F.col("text").endswith("}"), F.concat(F.regexp_replace(F.col("text"), r'\}$', ',"crs":'), crs, F.lit("}"))).otherwise(F.col("text")))
    out = files.validate_meta(t, "text")
    return out.select(F.substring("job_id", 4, 20).cast("bigint").alias("event_id"), "error")


@query("b01_grid_sink", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, row, col, round(CAST(CAST(coalesce(v, -9999) AS FLOAT) AS DOUBLE), 4) + 0.0 AS v, 'absolute' AS mode, 'gcp' AS method FROM g2""")
def b01(spark, d):
    out = sinks.grid_rows(fx.g2(fx.g1(spark, d)), tags={"mode": "absolute", "method": "gcp"})
    return r6(out.withColumn("v", F.col("v").cast("double")), ["v"], 4)


@query("b01_grid_sink_round_trip", fx.with_sql(fx.G1, fx.G2) + "SELECT scene, row, col, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM g2")
def b01_trip(spark, d):
    path = scratch_path(spark, "grid")
    sinks.write_grid(fx.g2(fx.g1(spark, d)), path, "dsm")
    stored = spark.read.parquet(path).where(F.col("layer") == "dsm")
    stored = stored.withColumn("v", F.when(F.col("v") != -9999.0, F.col("v").cast("double")))
    return r6(stored.select(*KEY, "v"), ["v"], 4)


@query("b02_bundle_grid", fx.with_sql(fx.G1, "hole AS (SELECT scene, row, col, CASE WHEN NOT (row < 12 AND col < 14) THEN v END AS v FROM g1)", "dims AS (SELECT scene, 50 AS h, 64 AS w FROM g1 GROUP BY scene)",
    area_sql("hole", "25", "32", "ar"),
    """nr AS (SELECT m.scene, m.row, m.col, arg_min(s.v, (pow(m.row - s.row, 2) + pow(m.col - s.col, 2)) * 1e8 + s.row * 1e4 + s.col) AS v
  FROM ar m JOIN ar s ON s.scene = m.scene WHERE m.v IS NULL AND s.v IS NOT NULL GROUP BY 1, 2, 3)""") + """
SELECT scene, row, col, round(coalesce(ar.v, nr.v), 6) + 0.0 AS v, NOT (ar.v IS NOT NULL AND frac >= 0.5) AS unreliable FROM ar LEFT JOIN nr USING (scene, row, col)""")
def b02(spark, d):
    grid, _ = bundle(spark, d)
    return r6(grid.select(*KEY, "v", "unreliable"), ["v"])


def bundle(spark, d):
    cells = fx.g1(spark, d)
    hole = cells.withColumn("v", F.when(~((F.col("row") < 12) & (F.col("col") < 14)), F.col("v")))
    sc = fx.scenes(cells).select("scene", "h", "w", "pixel_m")
    return sinks.bundle_tables(hole, sc, 32, fx.g2(cells))


@query("b02_bundle_metadata")
def b02_meta(spark, d):
    return r6(bundle(spark, d)[1], ["pixel_size_m", "min_h", "max_h"])


@query("b03_per_tile_union", """
SELECT o_orderkey AS tile, o_orderstatus AS method, o_totalprice AS rmse, NULL::VARCHAR AS cal_source FROM orders
UNION ALL SELECT l_orderkey, l_returnflag, l_quantity, l_linestatus FROM lineitem""")
def b03(spark, d):
    a = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("rmse"))
    b = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tile"), F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("rmse"), F.col("l_linestatus").alias("cal_source"))
    return sinks.union_per_tile([a, b])


@query("b04_run_record", fx.with_sql(fx.PER_TILE) + """
SELECT 'run-1' AS run_id, coalesce(landscape, 'all') AS landscape, method, count(*) AS tiles, round(avg(rmse), 6) + 0.0 AS rmse, round(avg(ndsm_rmse), 6) + 0.0 AS ndsm_rmse
FROM per_tile GROUP BY GROUPING SETS ((landscape, method), (method))""")
def b04(spark, d):
    record = sinks.run_record(ev.summarize(fx.per_tile(spark, d)), "run-1", {"split": "full"})
    x = record.select("run_id", F.explode("summary").alias("landscape", "m")).select("run_id", "landscape", F.explode("m").alias("method", "v"))
    return x.select("run_id", "landscape", "method", "v.tiles", rounded("v.rmse").alias("rmse"), rounded("v.ndsm_rmse").alias("ndsm_rmse"))


@query("a01_stored_grid_scan", fx.with_sql(fx.G1, LAYERS) + "SELECT scene, row, col, round(v, 6) + 0.0 AS v FROM ly WHERE layer = 'l2'")
def a01_stored(spark, d):
    path = scratch_path(spark, "cells")
    layers(fx.g1(spark, d)).select("scene", "layer", "row", "col", F.coalesce("v", F.lit(-9999.0)).alias("v")).write.partitionBy("layer").parquet(path)
    return r6(scan_grid(spark, path, "l2"), ["v"])


@query("st1_stream_catalogue", fx.with_sql(RESULT) + """
SELECT 'job' || event_id AS job_id, CASE WHEN event_id % 5 = 0 THEN 'job' || event_id ELSE 's' || k END AS name, event_id % 50 AS width, k AS height FROM rs WHERE event_id % 7 <> 0""")
def st1(spark, d):
    schema = "job_id string, text string, finished timestamp"
    path = scratch_path(spark, "texts")
    result_texts(spark, d).write.parquet(path)
    stream = files.catalogue_rows(spark.readStream.schema(schema).parquet(path))
    return streams.run_to_table(stream, "append").select("job_id", "name", "width", "height")


@query("st2_stream_accuracy", """
SELECT l_returnflag, l_linestatus, round(sqrt(avg(pow(l_extendedprice - 1500 * l_quantity, 2))), 4) + 0.0 AS rmse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) + 0.0 AS mae,
  round(avg(l_extendedprice - 1500 * l_quantity), 4) + 0.0 AS bias, count(*) AS count, round(max(abs(l_extendedprice - 1500 * l_quantity)), 4) + 0.0 AS max_abs FROM lineitem GROUP BY 1, 2""")
def st2(spark, d):
    schema = fx.table(spark, d, "lineitem").schema
    li = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    pairs = li.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("pred"), (F.col("l_quantity") * 1500.0).alias("ref"))
    out = streams.run_to_table(streams.stream_accuracy(pairs, ["l_returnflag", "l_linestatus"]), "complete")
    return r6(out, ["rmse", "mae", "bias", "max_abs"], 4)
