"""Accuracy metrics, exact quantiles, roll-ups and rankings."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from altigrid.functions.labels import fmt
from altigrid.functions.terrain import object_mask
from altigrid.operators import evaluation as ev
from altigrid.operators import metrics
from altigrid.operators.ranks import quantiles, value_ranks


def pairs(spark, pred, ref):
    pdf = pd.DataFrame({"g": 1, "pred": np.asarray(pred, float).ravel(), "ref": np.asarray(ref, float).ravel()})
    return spark.createDataFrame(pdf, "g int, pred double, ref double")


def test_noise_metrics(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(100, 10, (200, 200))
    pred = ref + 5 + rng.normal(0, 1, ref.shape)
    ref[0, 0] = np.nan
    m = metrics.dsm_metrics(pairs(spark, pred, ref), "pred", "ref", ["g"]).first()
    assert m.bias == pytest.approx(5, abs=0.05) and m.rmse == pytest.approx(math.sqrt(26), abs=0.05)
    assert m.nmad == pytest.approx(1, abs=0.05) and m.offset_free_rmse == pytest.approx(1, abs=0.05)
    assert m.n_pixels == 200 * 200 - 1 and m.pearson_r > 0.99


def test_constant_side_and_tiny_groups(spark):
    m = metrics.dsm_metrics(pairs(spark, [1, 2, 3], [7, 7, 7]), "pred", "ref", ["g"]).first()
    assert m.pearson_r == 0.0 and m.n_pixels == 3
    m = metrics.dsm_metrics(pairs(spark, [1, np.nan], [7, 7]), "pred", "ref", ["g"]).first()
    assert m.n_pixels == 1 and m.rmse is None
    assert metrics.dsm_metrics(pairs(spark, [1.0, 2.0], [1.0, 3.0]), "pred", "ref", []).first().rmse == pytest.approx(math.sqrt(0.5))


def test_scale_alignment(spark):
    ref = np.random.default_rng(1).normal(50, 20, (20, 20))
    m = metrics.relative_metrics(pairs(spark, 0.01 * ref - 4, ref), "pred", "ref", ["g"]).first()
    assert m.align_a == pytest.approx(100) and m.rmse < 1e-4


def test_object_mask(spark):
    df = spark.createDataFrame([(10.0, 10.0), (14.0, 10.0), (None, 10.0), (11.0, 10.0)], "dsm double, dtm double")
    assert [r[0] for r in df.select(object_mask("dsm", "dtm")).collect()] == [False, True, False, False]


def test_empty_groups_keep_their_row(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.5), ("b", None, 1.0), ("b", float("nan"), 3.0), ("c", 1.0, 1.0)], "g string, pred double, ref double")
    got = {r.g: r for r in metrics.dsm_metrics(df, "pred", "ref", ["g"]).collect()}
    assert {g: r.n_pixels for g, r in got.items()} == {"a": 2, "b": 0, "c": 1}
    assert got["a"].rmse == pytest.approx(math.sqrt((1 + 0.25) / 2)) and got["b"].rmse is None and got["c"].nmad is None
    flips = {r.g: r.r for r in metrics.polarity(df, "pred", "ref", ["g"]).collect()}
    assert flips == {"a": pytest.approx(1.0), "b": None, "c": None}


def test_medians_against_numpy(spark):
    rng = np.random.default_rng(3)
    pred, ref = rng.normal(size=3000), rng.normal(size=3000)
    got = metrics.dsm_metrics(pairs(spark, pred, ref), "pred", "ref", ["g"]).first()
    e = pred - ref
    assert got.nmad == pytest.approx(1.4826 * np.median(np.abs(e - np.median(e))), rel=1e-12)
    assert got.offset_free_rmse == pytest.approx(np.sqrt(np.mean((e - np.median(e)) ** 2)), rel=1e-9)


@pytest.mark.parametrize("sort_rows", [4_000_000, 5])
def test_quantiles_with_splits_and_hot_ties(spark, sort_rows):
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.normal(size=2000), np.zeros(1500), [1e300, -1e300, 5e-324, np.nan, np.inf]])
    other = rng.lognormal(3, 2, 401)
    pdf = pd.concat([pd.DataFrame({"g": 1, "x": hot}), pd.DataFrame({"g": 2, "x": other}), pd.DataFrame({"g": 3, "x": [np.nan]})])
    df = spark.createDataFrame(pdf, "g int, x double").repartition(7)
    probs = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p98": 0.98, "p100": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], {n: ("x", p) for n, p in probs.items()}, sort_rows=sort_rows).collect()}
    assert set(got) == {1, 2}
    for g, x in ((1, hot[np.isfinite(hot)]), (2, other)):
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-300)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_value_ranks_property(spark, xs):
    df = spark.createDataFrame([(1, float(x)) for x in xs], "g int, x double")
    got = {r.v: (r.n, r.below, r.total) for r in value_ranks(df, ["g"], "x").collect()}
    assert got == {v + 0.0: (xs.count(v), sum(x < v for x in xs), len(xs)) for v in set(xs)}


# Golden values of a published evaluation run (five tiles, three methods; rmse and objects-only rmse).
GOLDEN = [
    ("denver/0_1", "urban", 21.63518065174446, 20.58226446478376, 21.496519303076877, 24.966284490736346, 22.767890141053023, 24.76966754074151),
    ("austin/0_2", "urban", 10.83901477538395, 22.240174816173326, 10.696431730524939, 14.660650523417427, 27.962330799485983, 14.501388951822065),
    ("palouse/0_1", "sparse", 1.2503459688895846, 12.410730852269586, 1.2524084123399115, None, None, None),
    ("boulder/0_2", "hilly", 2.744423270852811, 39.590039033219576, 2.744423270852811, 2.250542395078381, 42.796907385011004, 2.250542395078381),
    ("smokies/0_1", "forested", 7.41340019584204, 105.13261647398387, 7.255090050165794, 7.2858452538952525, 105.18370960938171, 7.163743464216117),
]


def test_golden_rollup(spark):
    rows = []
    for tile, land, *v in GOLDEN:
        for i, method in enumerate(("dem_only", "method_a", "method_b")):
            rows.append((tile, land, method, v[i], v[3 + i]))
    df = spark.createDataFrame(rows, "tile string, landscape string, method string, rmse double, ndsm_rmse double")
    for m in metrics.METRICS:
        if m != "rmse":
            df = df.withColumn(m, F.lit(None).cast("double"))
    s = {(r.landscape, r.method): r for r in ev.summarize(df).collect()}
    want = {"dem_only": (8.776472972542567, 12.290830665781852), "method_a": (39.991165128086024, 49.677709483732926), "method_b": (8.688974553392066, 12.171335587964519)}
    for method, (rmse, nd) in want.items():
        r = s[("all", method)]
        assert r.tiles == 5 and r.rmse == pytest.approx(rmse, rel=1e-12) and r.ndsm_rmse == pytest.approx(nd, rel=1e-12)
    assert s[("sparse", "dem_only")].ndsm_rmse is None and s[("urban", "method_b")].tiles == 2
    top = ev.worst_tiles(df, "method_b", 2).collect()
    assert [r.tile for r in top] == ["denver/0_1", "austin/0_2"]
    assert [r.tile for r in ev.diverse_worst(df, "method_b").collect()] == ["denver/0_1", "smokies/0_1"]


def test_polarity_verdicts(spark):
    def verdict(*rs):
        return metrics.polarity_verdict(spark.createDataFrame([(float(r),) for r in rs], "r double")).first().verdict

    assert (verdict(0.5, 0.6), verdict(0.9, -0.1, 0.5), verdict(-0.5, -0.6, 2.0)) == ("ok", "warning", "flipped")


def test_fixed_digits_follow_the_binary_value(spark):
    xs = [249.845, 0.125, 0.375, 2.675, -1.005, 1e-9, 123456.785, -0.5, 0.995, 1.0, 99.999]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(fmt("x", 2).alias("a"), fmt("x", 3).alias("b")).collect()
    assert [(g.a, g.b) for g in got] == [(f"{x:.2f}", f"{x:.3f}") for x in xs]


def test_balanced_sample(spark):
    names = [(f"{c}", f"{c}_{i:03d}") for c, n in (("A", 40), ("B", 7), ("C", 1)) for i in range(n)]
    df = spark.createDataFrame(names, "city string, stem string").repartition(5)
    want = []
    for c, n in (("A", 40), ("B", 7), ("C", 1)):
        want += [f"{c}_{i:03d}" for i in np.unique(np.linspace(0, n - 1, min(4, n)).round().astype(int))]
    assert [r.stem for r in ev.select_balanced(df, "city", "stem", 12).collect()] == sorted(want)[:12]
