"""Overlapping tile layout as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col


def tile_origins(length, tile: int, stride: int) -> Column:
    """Start offsets covering ``[0, length)``; the last tile sits flush with the end."""
    length = as_col(length).cast("int")
    end = length - tile
    regular = F.sequence(F.lit(0), end, F.lit(stride))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(end))))


def covering_origins(pos, length, tile: int, stride: int) -> Column:
    """Starts of the tiles that contain position ``pos``: the same tiles as :func:`tile_origins`,
    found by arithmetic instead of listing them all for every cell."""
    pos, end = as_col(pos).cast("int"), as_col(length).cast("int") - tile
    first = F.greatest(F.ceil((pos - tile + 1) / stride), F.lit(0)).cast("int")
    last = F.floor(F.least(pos, end) / stride).cast("int")
    regular = F.when(last >= first, F.sequence(first * stride, last * stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    flush = F.when((pos >= end) & (end % stride != 0), F.array(end)).otherwise(F.array().cast("array<int>"))
    return F.when(end <= 0, F.array(F.lit(0))).otherwise(F.concat(regular, flush))


def tile_borders(length, tile: int, stride: int) -> Column:
    """Offsets strictly inside ``(0, length)`` where some tile starts or ends."""
    starts = tile_origins(length, tile, stride)
    edges = F.array_union(starts, F.transform(starts, lambda s: s + tile))
    return F.array_sort(F.filter(edges, lambda e: (e > 0) & (e < as_col(length))))


def taper(i, n: int, flat_start, flat_end) -> Column:
    """Sine-squared weight of position ``i`` in a tile of ``n``; sides on the scene edge stay 1."""
    i = as_col(i)
    bell = F.pow(F.sin(math.pi * (i + 0.5) / n), 2)
    held = (as_col(flat_start) & (i < n // 2)) | (as_col(flat_end) & (i >= n // 2))
    return F.when(held, 1.0).otherwise(bell)


def tile_weight(row, col, y0, x0, tile: int, h, w) -> Column:
    """Blending weight of a cell inside the tile at (y0, x0)."""
    row, col, y0, x0 = map(as_col, (row, col, y0, x0))
    down = taper(row - y0, tile, y0 == 0, y0 + tile >= as_col(h))
    across = taper(col - x0, tile, x0 == 0, x0 + tile >= as_col(w))
    return down * across
