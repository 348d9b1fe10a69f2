"""Sources, sinks, streams and text rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from altigrid.functions import geo, labels
from altigrid.functions.tiles import tile_origins
from altigrid.operators.stretch import stretch
from altigrid.sources import files, listings, sinks
from altigrid.streaming import jobs as streams


def test_packed_grids(spark, tmp_path, to_grid):
    g = np.arange(12, dtype="<f4").reshape(3, 4)
    g[1, 2] = np.nan
    d = tmp_path / "a"
    d.mkdir()
    (d / "dsm.bin").write_bytes(g.tobytes())
    (d / "meta.json").write_text(json.dumps({"width": 4, "height": 3, "units": "m"}, indent=2))
    out = files.scan_packed(spark, str(tmp_path))
    assert np.array_equal(to_grid(out), g.astype(float), equal_nan=True)
    (d / "dsm.bin").write_bytes(g.tobytes()[:-4])
    with pytest.raises(Exception, match="cannot be read from"):
        files.scan_packed(spark, str(tmp_path)).count()


def write_results(root):
    for i, (job, text) in enumerate([
        ("j1", json.dumps({"source_name": "A", "width": 5, "height": 4, "units": "m", "pixel_size_m": 0.5}, indent=2)),
        ("j2", json.dumps({"source_name": "", "width": 9, "height": 9})), ("j3", '{"width": 5, '),
    ]):
        d = root / job / "out" / "bundle"
        d.mkdir(parents=True)
        (d / "meta.json").write_text(text)
        import os

        os.utime(d / "meta.json", (1_700_000_000 + i, 1_700_000_000 + i))


def test_catalogue_batch_and_stream(spark, tmp_path):
    write_results(tmp_path)
    rows = files.list_results(spark, str(tmp_path)).collect()
    assert [(r.job_id, r.name, r.width) for r in rows] == [("j2", "j2", 9), ("j1", "A", 5)]
    streamed = streams.run_to_table(streams.stream_results(spark, str(tmp_path)), "append").collect()
    assert sorted(r.job_id for r in streamed) == ["j1", "j2"]


def test_metadata_rules(spark):
    ok = {"width": 5, "height": 4, "pixel_size_m": 2.0, "min_h": 1.0, "max_h": 2.0}
    cases = [ok, {**ok, "width": 1}, {**ok, "height": 2.5}, {**ok, "width": 10001, "height": 10000}, {**ok, "pixel_size_m": 0}, {**ok, "min_h": 3.0}, {**ok, "units": "feet"}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(7, "[1]")], "i int, t string")
    out = {r.i: r for r in files.validate_meta(df, "t").collect()}
    assert out[0].error is None and out[0].meta.units == "relative"
    words = {1: "width", 2: "height", 3: "limit", 4: "pixel size", 5: "height range", 6: "units", 7: "object"}
    assert all(w in out[i].error for i, w in words.items())


def test_control_points(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_bytes("﻿ Lon , LAT,Height_M\n88.5, 27.25 ,100\n88.6,27.5,120.5\n".encode())
    out = listings.scan_control_points(spark, str(p))
    assert [tuple(r) for r in out.orderBy("lon").collect()] == [(0, 88.5, 27.25, 100.0), (0, 88.6, 27.5, 120.5)]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="needs height_m"):
        listings.scan_control_points(spark, str(p))
    p.write_text("x,y,height_m\n")
    with pytest.raises(ValueError, match="no control point"):
        listings.scan_control_points(spark, str(p))


def test_split_list(spark, tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("# head\nnaip3dep/a/0_1  # note\n\ngamus/test/X_1\nother/x/1_1\n")
    rows = listings.scan_split(spark, str(p)).orderBy("pos").collect()
    assert [(r.tile, r.mode) for r in rows] == [("naip3dep/a/0_1", "metric"), ("gamus/test/X_1", "relative"), ("other/x/1_1", None)]


def test_degree_tile_names(spark):
    df = spark.createDataFrame([(88.30, 27.10, 88.42, 27.21), (-105.01, 39.70, -104.90, 39.80), (-0.5, -0.5, 0.5, 0.5)], "w double, s double, e double, n double")
    names = sorted(r.tile_name[22:].replace("_00", "").replace("_DEM", "") for r in labels.degree_tiles(df, "w", "s", "e", "n").collect())
    assert names == ["N00_E000", "N00_W001", "N27_E088", "N39_W105", "N39_W106", "S01_E000", "S01_W001"]


def test_elevation_sources(spark):
    paths = ["data/dem/CartoDEM/x.tif", "a/cdng45e.tif", "b/Copernicus_DSM_10.tif", "c/mine.v2.tif", "d/srtm_1.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(labels.infer_source("p").alias("s"))
    got = df.select("s", labels.datum_of("s").alias("d")).collect()
    assert [r.s for r in got] == ["cartodem", "cartodem", "copernicus_glo30", "mine.v2", "srtm"]
    assert [r.d for r in got][2:] == ["EGM2008", "unknown", "EGM96"]


def test_tile_starts(spark):
    for n in (100, 518, 519, 777, 1036, 1500):
        s = spark.range(1).select(tile_origins(F.lit(n), 518, 259)).first()[0]
        assert s[0] == 0 and s[-1] + 518 == max(n, 518) and len(set(s)) == len(s)


def test_utm_known_values(spark):
    df = spark.createDataFrame([(-105.0, 40.0, 32613), (88.42, 27.21, 32645), (151.2, -33.87, 32756)], "lon double, lat double, epsg int")
    out = geo.add_lonlat(geo.add_utm(df, "lon", "lat", "epsg"), "x", "y", "epsg", "lon2", "lat2").collect()
    assert out[0].x == pytest.approx(500000, abs=1e-6) and out[0].y == pytest.approx(4427757.219, abs=0.01)
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in out)
    zones = df.select(geo.utm_epsg("lon", "lat").alias("z")).collect()
    assert [z.z for z in zones] == [32613, 32645, 32756]


def test_stretch_of_16_bit_bands(spark):
    df = spark.range(0, 4001).select((F.col("id") % 2).alias("band"), F.col("id").cast("double").alias("x"), F.col("id").cast("int").alias("row"))
    out = stretch(df, "x", ["band"]).agg(F.min("level"), F.max("level"), F.countDistinct("level")).first()
    assert tuple(out) == (0, 255, 256)


def test_bundle_caps_fills_and_masks(spark, to_cells, to_grid):
    h, w = 300, 450
    terrain = np.tile(np.linspace(100, 200, w), (h, 1))
    dsm = terrain + 5
    dsm[:30, :30] = np.nan
    terrain[-6:, -6:] = np.nan
    dsm[-6:, -6:] = np.nan
    sc = spark.createDataFrame([(0, h, w, 0.5)], "scene bigint, h int, w int, pixel_m double")
    grid, meta = sinks.bundle_tables(to_cells(dsm), sc, 205, to_cells(terrain))
    m = meta.first()
    assert max(m.width, m.height) == 205 and m.pixel_size_m == pytest.approx(0.5 * 450 / 205, abs=2e-3) and m.has_mask
    v, d = to_grid(grid), to_grid(grid, "dem")
    assert np.isfinite(v).all() and np.isfinite(d).all() and np.allclose(v - d, 5, atol=1e-3)
    mask = to_grid(grid.withColumn("u", F.col("unreliable").cast("int")), "u")
    assert mask[0, 0] == 1 and mask[70, 100] == 0


def test_written_tables(spark, tmp_path, to_cells):
    g = np.array([[1.0, np.nan], [3.0, 4.0]])
    sinks.write_grid(to_cells(g), str(tmp_path / "g"), "dsm", tags={"mode": "absolute"})
    from altigrid.sources.grids import scan_grid

    back = scan_grid(spark, str(tmp_path / "g"), "dsm")
    assert sorted((r.row, r.col, r.v) for r in back.where("v IS NOT NULL").collect()) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert back.where("v IS NULL").count() == 1


def test_profile_csv(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 0, 0.0, 1.5, 0.0, 0.0, None, None)], "scene int, line int, i int, distance double, height double, col_f double, row_f double, slope double, error double")
    sinks.write_profile(p, str(tmp_path / "p"), "m")
    text = next((tmp_path / "p").rglob("*.csv")).read_text().splitlines()
    assert text == ["distance_m,height_m,column,row,slope_deg,error_m", "0.0,1.5,0.0,0.0,,"]
