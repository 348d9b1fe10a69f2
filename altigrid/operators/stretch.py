"""Percentile stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altigrid.functions.numbers import clip
from altigrid.model import attach, cut, finite
from altigrid.operators.ranks import quantiles

FLOAT32_EPS = 1.1920928955078125e-07  # fixed value: single-precision epsilon


def _scaled(df: DataFrame, value: str, by: list[str], p: tuple[float, float], floor: float) -> DataFrame:
    """Adds ``_t``: the value's place between two percentiles of its group, clipped to 0..1."""
    ends = cut(quantiles(df, by, {"_lo": (value, p[0] / 100.0), "_hi": (value, p[1] / 100.0)}))
    joined = attach(df, ends, by, "left")
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(floor))
    return joined.withColumn("_t", clip((finite(value) - F.col("_lo")) / span, 0.0, 1.0)).drop("_lo", "_hi")


def stretch(
    df: DataFrame, value: str, by: list[str], p: tuple[float, float] = (2, 98), levels: int = 255, floor: float = 1e-6
) -> DataFrame:
    """Integer ``level`` in ``0..levels``; missing values are 0."""
    t = F.coalesce(F.col("_t"), F.lit(0.0))
    return _scaled(df, value, by, p, floor).withColumn("level", F.floor(t * levels + 0.5).cast("int")).drop("_t")


def normalize_relative(cells: DataFrame, p: tuple[float, float] = (1, 99)) -> DataFrame:
    """Relative heights in 0..1 per scene; missing stays missing."""
    return _scaled(cells, "v", ["scene"], p, FLOAT32_EPS).withColumn("v", F.col("_t")).drop("_t")
