"""Text listings: split lists (A6) and control-point files (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dataset prefixes of a split list and how their tiles are scored.
PREFIX_MODES = {"naip3dep/": "metric", "gamus/": "relative"}


def split_entries(lines: DataFrame) -> DataFrame:
    """A6 on a ``pos, value`` table: comments and blanks dropped, scoring mode by prefix."""
    tile = F.trim(F.split("value", "#")[0])
    mode = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, name in PREFIX_MODES.items():
        mode = mode.when(F.col("tile").startswith(prefix), name)
    return lines.select("pos", tile.alias("tile")).where(F.col("tile") != "").withColumn("mode", mode)


def scan_split(spark: SparkSession, path: str) -> DataFrame:
    """Read a split list. A list is one small text file; line order is kept in ``pos``."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    return split_entries(lines.select(F.col("pos").cast("bigint").alias("pos"), "value"))


def scan_control_points(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``x, y, height_m`` or ``lon, lat, height_m`` with tolerant headers.

    The header is checked when the plan is built (one line is read); the rows stay distributed.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True
    ).csv(path)
    names = {c: c.replace("﻿", "").strip().lower() for c in raw.columns}
    points = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = set(names.values())
    if {"x", "y", "height_m"} <= found:
        place = ["x", "y"]
    elif {"lon", "lat", "height_m"} <= found:
        place = ["lon", "lat"]
    else:
        raise ValueError(f"{path}: a control point file needs height_m and either x and y or lon and lat, but has {sorted(found)}")
    if points.isEmpty():
        raise ValueError(f"{path}: no control point rows.")
    scene = F.col("scene").cast("bigint") if "scene" in found else F.lit(0).cast("bigint")
    return points.select(scene.alias("scene"), *[F.trim(c).cast("double").alias(c) for c in [*place, "height_m"]])
