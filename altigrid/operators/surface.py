"""Derived surfaces and their classes (C14-C17), distributions and flooding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.functions.numbers import clip
from altigrid.functions.terrain import (
    SLOPE_SATURATION_DEG, shade, signed_share, slope_degrees, unit_normal,
)
from altigrid.model import attach, cut, finite
from altigrid.operators.metrics import NMAD_K, finite_range, median_and_mad
from altigrid.operators.neighbourhood import differences
from altigrid.operators.ranks import value_ranks

FLOOD_STEPS, FLOOD_CURVE = 500, 2  # fixed values: slider positions and their curve
ERROR_CLAMP_NMAD = 3.0


def slope(cells: DataFrame, px=1.0) -> DataFrame:
    """C14: ``gx, gy, slope_deg, nx, ny, nz``; all NULL where one of the neighbours is missing."""
    d = differences(cells, px)
    known = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    d = d.withColumn("gx", F.when(known, F.col("gx"))).withColumn("gy", F.when(F.col("gx").isNotNull(), F.col("gy")))
    d = d.withColumn("slope_deg", slope_degrees("gx", "gy")).withColumn("_n", unit_normal("gx", "gy"))
    return d.select("*", "_n.nx", "_n.ny", "_n.nz").drop("_n")


def hillshade(cells: DataFrame, px=1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shaded relief. Missing heights stand at the scene minimum before shading."""
    low = cells.groupBy("scene").agg(F.min("v").alias("_low"))
    solid = attach(cells, low).withColumn("v", F.coalesce("v", "_low")).drop("_low")
    return differences(solid, px).withColumn("shade", shade("gx", "gy", azimuth, altitude)).drop("gx", "gy")


def normalised_error(df: DataFrame, pred: str, ref: str, by: list[str], clamp_nmad: float = ERROR_CLAMP_NMAD) -> DataFrame:
    """``share`` of the error within ``clamp_nmad`` NMADs of its tile, -1..1."""
    e = cut(df.withColumn("_e", finite(pred) - finite(ref)))
    _, mad = median_and_mad(e, "_e", by)
    nmad = cut(mad.select(*by, (NMAD_K * F.col("_mad")).alias("_nmad")))
    unit = F.when(F.coalesce(F.col("_nmad"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_nmad"))
    return attach(e, nmad, by, "left").withColumn("share", signed_share("_e", clamp_nmad * unit)).drop("_e", "_nmad")


def terrain_classes(cells: DataFrame, step: float, slope_col: str | None = None) -> DataFrame:
    """C17: height share of the scene range, contour band and distance to the nearest contour line;
    with ``slope_col`` also the slope share, saturating at 60 degrees."""
    rng = finite_range(cells, ["scene"]).select("scene", "min_h", "max_h")
    x = attach(cells, rng)
    above = F.col("v") - F.col("min_h")
    v = above / F.lit(float(step))
    x = x.withColumn("height_share", clip(above / F.greatest(F.col("max_h") - F.col("min_h"), F.lit(0.001)), 0.0, 1.0))
    x = x.withColumn("band", F.floor(v)).withColumn("line_distance", F.abs(v + 0.5 - F.floor(v + 0.5) - 0.5))
    if slope_col:
        x = x.withColumn("slope_share", clip(F.col(slope_col) / SLOPE_SATURATION_DEG, 0.0, 1.0))
    return x.drop("min_h", "max_h")


def segments(df: DataFrame, line: str, order: str, value: str) -> DataFrame:
    """consecutive non-missing points of a line share a ``segment`` number (from 1).

    A line has a bounded number of points (transects are capped), so one window per line is safe.
    """
    w = Window.partitionBy(line).orderBy(order)
    here = F.col(value).isNotNull()
    starts = here & F.coalesce(F.lag(value).over(w).isNull(), F.lit(True))
    return (
        df.withColumn("_start", starts.cast("int"))
        .withColumn("segment", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(here)
        .drop("_start")
    )


def height_cdf(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """each distinct height with the share of cells strictly below and at or below it."""
    r = value_ranks(cells, by or ["scene"], "v")
    total = F.col("total").cast("double")
    return r.select(
        *(by or ["scene"]), F.col("v"), "n", (F.col("below") / total).alias("share_below"),
        ((F.col("below") + F.col("n")) / total).alias("share_upto"),
    )


def flood_level(step: Column, low: Column, high: Column) -> Column:
    """Water level at a slider step: rises with the square of the step over the height range."""
    return low + F.pow(step.cast("double") / FLOOD_STEPS, FLOOD_CURVE) * (high - low)


def flooded_share(cells: DataFrame, steps: int = FLOOD_STEPS, shown: DataFrame | None = None) -> DataFrame:
    """Share of finite cells strictly below the water level, for every step 1..``steps``.

    The level range always comes from ``cells``; ``shown`` may be another surface (the DEM). Each
    cell is counted once, at the first step that floods it; the running sum over the steps gives the
    shares. No cell is multiplied by the number of steps.
    """
    span = finite_range(cells, ["scene"]).where("count > 0").select("scene", "min_h", "max_h")
    x = attach((shown if shown is not None else cells).where(finite("v").isNotNull()).select("scene", "row", "col", "v"), span)
    low, high = F.col("min_h"), F.col("max_h")
    share = F.try_divide(F.col("v") - low, high - low)
    guess = F.floor(FLOOD_STEPS * F.sqrt(clip(share, 0.0, 4.0)))
    around = [F.greatest(guess + k, F.lit(1)).cast("int") for k in (-1, 0, 1, 2)]
    floods = F.least(*[F.when(F.col("v") < flood_level(s, low, high), s) for s in around])
    first = F.coalesce(floods, F.lit(10**9))  # a level never reached in the series
    counts = x.withColumn("_s", first).groupBy("scene", "_s").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("scene").agg(F.sum("_n").alias("_total"))
    frame = totals.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    merged = frame.join(counts.withColumnRenamed("_s", "step"), ["scene", "step"], "left")
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(
        Window.partitionBy("scene").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = merged.withColumn("share", upto / F.col("_total").cast("double"))
    return out.join(span, "scene").select(
        "scene", "step", flood_level(F.col("step"), low, high).alias("level"), "share"
    )
