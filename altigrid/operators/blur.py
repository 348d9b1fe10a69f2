"""Gaussian blur and band split."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.model import KEY, attach, finite, scene_extent, meet
from altigrid.operators.neighbourhood import blocked
from altigrid.operators.resample import area_resize, enlarge_onto

DIRECT_SIGMA = 4.0  # fixed value: wider blurs work on an area-reduced grid
REACH = 4.0  # kernel radius in sigmas


def _blur_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Separable blur of one block with its halo; the border is mirrored only at true grid edges."""
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    top, left = row.min(), col.min()
    grid = np.full((row.max() - top + 1, col.max() - left + 1), np.nan)
    grid[row - top, col - left] = pdf["v"].to_numpy(dtype=float)
    h, w, sigma = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), float(pdf["sigma"].iloc[0])
    radius = math.ceil(REACH * sigma)
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2.0 * sigma * sigma))
    kernel /= kernel.sum()
    pad = [
        (radius if top == 0 else 0, radius if row.max() == h - 1 else 0),
        (radius if left == 0 else 0, radius if col.max() == w - 1 else 0),
    ]
    out = np.pad(grid, pad, mode="symmetric")
    n = out.shape[1] - 2 * radius
    out = sum(k * out[:, i : i + n] for i, k in enumerate(kernel))
    n = out.shape[0] - 2 * radius
    out = sum(k * out[i : i + n] for i, k in enumerate(kernel))
    core = pdf["core"].to_numpy()
    r, c = row[core], col[core]
    v = out[r - top + pad[0][0] - radius, c - left + pad[1][0] - radius]
    return pd.DataFrame({"scene": pdf["scene"].iloc[0], "row": r, "col": c, "v": v})


def _blur(cells: DataFrame, extent: DataFrame, radius: int) -> DataFrame:
    """Blur every block in one task; ``extent``: scene, h, w, sigma (radius is the widest reach).

    A group is one block and its halo, at most (block + 2 radius)^2 cells whatever the scene size.
    """
    b = blocked(attach(cells.select(*KEY, "v"), extent), radius, radius)
    out = b.groupBy("scene", "br", "bc").applyInPandas(_blur_block, "scene bigint, row int, col int, v double")
    return out.withColumn("v", finite("v"))


def gaussian(cells: DataFrame, sigma: float | str) -> DataFrame:
    """the blurred grid, see :func:`smoothed`."""
    return smoothed(cells, sigma, "_smooth").select(*KEY, F.col("_smooth").alias("v"))


def smoothed(cells: DataFrame, sigma: float | str, out: str) -> DataFrame:
    """Adds the blurred value: blur with a reflected border (edge cell repeated), weights exp(-k^2 / 2 sigma^2) for
    |k| <= ceil(4 sigma), normalised; a missing cell makes every cell in reach missing.

    ``sigma`` in cells is a number, or a per-scene column of ``cells``. Above 4 cells the grid is
    area-reduced by ``floor(sigma / 4)``, blurred by what is left and enlarged bilinearly; the area
    mean counts as variance f^2/12.
    """
    if isinstance(sigma, str):
        return _smoothed_by_scene(cells, sigma, out)
    sigma = float(sigma)
    ext = scene_extent(cells)
    f = int(sigma // DIRECT_SIGMA) if sigma > DIRECT_SIGMA else 1
    rest = math.sqrt(max(sigma**2 - f**2 / 12.0, 0.0)) / f if sigma > DIRECT_SIGMA else sigma
    radius = math.ceil(REACH * rest)
    if f == 1:
        low = _blur(cells, ext.withColumn("sigma", F.lit(rest)), radius)
        return meet(cells, low.select(*KEY, F.col("v").alias(out)))
    dims = _reduced(ext, F.lit(f))
    small = area_resize(cells, dims).select(*KEY, "v")
    part = dims.select("scene", F.col("h2").alias("h"), F.col("w2").alias("w"), F.lit(rest).alias("sigma"))
    return enlarge_onto(cells, _blur(small, part, radius), dims, out)


def _reduced(extent: DataFrame, f: Column) -> DataFrame:
    return extent.withColumn("h2", F.greatest(F.lit(1), F.floor(F.col("h") / f)).cast("int")).withColumn(
        "w2", F.greatest(F.lit(1), F.floor(F.col("w") / f)).cast("int")
    )


def _smoothed_by_scene(cells: DataFrame, sigma: str, out: str) -> DataFrame:
    """Scenes with different sigmas in one plan: after reduction every sigma is below 8 cells."""
    s = F.col(sigma)
    f = F.when(s > DIRECT_SIGMA, F.greatest(F.floor(s / DIRECT_SIGMA), F.lit(1))).otherwise(F.lit(1))
    rest = F.when(s > DIRECT_SIGMA, F.sqrt(F.greatest(s * s - f * f / 12.0, F.lit(0.0))) / f).otherwise(s)
    ext = cells.groupBy("scene").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.max(sigma).alias(sigma))
    dims = _reduced(ext, f).withColumn("_rest", rest)
    part = dims.select("scene", F.col("h2").alias("h"), F.col("w2").alias("w"), F.col("_rest").alias("sigma"))
    small = area_resize(cells, dims.select("scene", "h", "w", "h2", "w2")).select(*KEY, "v")
    blurred = _blur(small, part, math.ceil(REACH * 2 * DIRECT_SIGMA))
    return enlarge_onto(cells, blurred, dims, out)


def band_split(cells: DataFrame, scenes: DataFrame, k: float, sigma: float | None = None) -> DataFrame:
    """``low`` = blur with ``sigma = k * dem_res_m / pixel_m``, ``high`` = value minus low.

    Pass ``sigma`` when all scenes share it; the plan is then the shorter one.
    """
    if sigma is not None:
        both = smoothed(cells, sigma, "low")
    else:
        s = scenes.select("scene", (F.lit(float(k)) * F.col("dem_res_m") / F.col("pixel_m")).alias("_sigma"))
        both = smoothed(attach(cells, s), "_sigma", "low").drop("_sigma")
    return both.withColumn("high", F.col("v") - F.col("low"))
