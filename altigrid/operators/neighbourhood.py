"""Neighbourhoods of grid cells (F1, F4 and the stencils behind resampling and blurring).

Cells are grouped in square blocks with a halo of copied border cells. One hash shuffle by block
serves the row-wise and the column-wise windows alike, every window holds at most ``block`` plus
halo cells, and a scene with most of the data is spread over all its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col
from altigrid.model import KEY, cell_parts, cut, meet

BLOCK = 256


def _covering(pos: Column, before: int, after: int, block: int) -> Column:
    """Blocks whose halo (``before`` cells ahead of the core, ``after`` behind) covers ``pos``."""
    lo = F.greatest(F.floor((pos - after) / block), F.lit(0))
    hi = F.floor((pos + before) / block)
    return F.sequence(lo.cast("int"), hi.cast("int"))


def blocked(cells: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Cells under each block that needs them: adds ``br, bc, core``; hash-partitioned by block, see :func:`altigrid.model.cell_parts`."""
    out = cells.withColumn("br", F.explode(_covering(F.col("row"), before, after, block)))
    out = out.withColumn("bc", F.explode(_covering(F.col("col"), before, after, block)))
    core = (F.floor(F.col("row") / block) == F.col("br")) & (F.floor(F.col("col") / block) == F.col("bc"))
    return out.withColumn("core", core).repartition(cell_parts(cells.sparkSession), "scene", "br", "bc")


def along_row() -> Window:
    return Window.partitionBy("scene", "br", "bc", "row").orderBy("col")


def along_col() -> Window:
    return Window.partitionBy("scene", "br", "bc", "col").orderBy("row")


def _central(v: str, pos: str, w: Window, px: Column) -> Column:
    """Central difference, one-sided at the grid edge, NULL when a used neighbour is missing."""
    has_prev, has_next = F.lag(pos).over(w).isNotNull(), F.lead(pos).over(w).isNotNull()
    lo = F.when(has_prev, F.lag(v).over(w)).otherwise(F.col(v))
    hi = F.when(has_next, F.lead(v).over(w)).otherwise(F.col(v))
    steps = has_prev.cast("int") + has_next.cast("int")
    return F.try_divide(hi - lo, steps * px)


def differences(cells: DataFrame, px=1.0, block: int = BLOCK) -> DataFrame:
    """``gx`` (east) and ``gy`` (south) per metre. ``px`` is a number or a column of ``cells``."""
    px = as_col(px) if isinstance(px, (str, Column)) else F.lit(float(px))
    b = blocked(cells, 1, 1, block)
    b = b.withColumn("gx", _central("v", "col", along_row(), px))
    b = b.withColumn("gy", _central("v", "row", along_col(), px))
    return b.where("core").drop("br", "bc", "core")


def corners(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each cell with its east, south and south-east neighbour: ``v00, v01, v10, v11``."""
    b = blocked(cells.select(*KEY, F.col("v").alias("v00")), 0, 1, block)
    b = b.withColumn("v01", F.lead("v00").over(along_row()))
    b = b.withColumn("v10", F.lead("v00").over(along_col())).withColumn("v11", F.lead("v01").over(along_col()))
    return b.where("core").drop("br", "bc", "core")


def patch4(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each cell with the 4x4 patch from one cell before to two cells after, as ``p`` (rows)."""
    b = blocked(cells.select(*KEY, "v"), 1, 2, block)
    r, c = along_row(), along_col()
    b = b.withColumn("_h", F.array(F.lag("v").over(r), F.col("v"), F.lead("v").over(r), F.lead("v", 2).over(r)))
    b = b.withColumn("p", F.array(F.lag("_h").over(c), F.col("_h"), F.lead("_h").over(c), F.lead("_h", 2).over(c)))
    return b.where("core").select(*KEY, "p")


def column_sources(cells: DataFrame, also: str, block: int = BLOCK) -> DataFrame:
    """Every cell with the nearest valid cell of its own column: ``_s`` (row, v, a), NULL if the column has none.

    The nearest one above and below is looked for inside blocks of rows. The ends of the blocks, one row
    per block and column, are carried over the blocks, so no window holds a whole column of cells.
    Of two that are equally near the upper one counts.
    """
    source = F.when(F.col("v").isNotNull(), F.struct("row", "v", F.col(also).alias("a")))
    base = cells.withColumn("_rb", F.floor(F.col("row") / block).cast("int")).withColumn("_src", source)
    own = ["scene", "_rb", "col"]
    ends = base.groupBy(*own).agg(F.max_by("_src", F.when(F.col("v").isNotNull(), F.col("row"))).alias("_low"), F.min_by("_src", F.when(F.col("v").isNotNull(), F.col("row"))).alias("_high"))
    over = Window.partitionBy("scene", "col").orderBy("_rb")
    carried = ends.select(
        *own, F.last("_low", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
        F.first("_high", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_below"))
    w = Window.partitionBy(*own).orderBy("row")
    near = base.withColumn("_up", F.last("_src", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_down", F.first("_src", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = near.join(carried, own)
    up, down = F.coalesce("_up", "_above"), F.coalesce("_down", "_below")
    closer_up = down.isNull() | (F.col("row") - up["row"] <= down["row"] - F.col("row"))
    return near.select(*KEY, F.col("v").isNull().alias("gap"), F.when(closer_up, up).otherwise(down).alias("_s"))


FILL_ROWS, FILL_COLS = 64, 256


def fill_nearest(cells: DataFrame, also: str | None = None) -> DataFrame:
    """each missing cell takes the value of the Euclidean-nearest valid cell.

    Adds ``filled``. Ties go to the smallest source row, then column. ``also`` names a second value
    column that follows the same source cell.

    Two separable exact passes: the nearest valid cell of each column (:func:`column_sources`), then the
    best column. For the second, each stretch of a row states how near its column sources come at best;
    that bounds a gap's distance from above and every stretch's from below, so a gap asks only the few
    stretches that may hold its source. Asks and sources meet in tiles of bounded size.
    """
    extra = F.col(also).cast("double") if also else F.lit(None).cast("double")
    near = column_sources(cells.withColumn("_also", extra), "_also")
    gaps = cells.where(F.col("v").isNull()).select("scene", "row").distinct()
    near = near.join(gaps, ["scene", "row"], "left_semi").withColumn("_cb", F.floor(F.col("col") / FILL_COLS).cast("int"))
    near = cut(near)  # read as sources and as gaps
    drop = F.col("row") - F.col("_s.row")
    best = near.where("_s is not null").groupBy("scene", "row", "_cb").agg(F.min((drop * drop).cast("bigint")).alias("d"))
    # one entry per stretch of the row
    reach = best.groupBy("scene", "row").agg(F.collect_list(F.struct("_cb", "d")).alias("_reach"))
    c, first = F.col("col").cast("bigint"), lambda x: x["_cb"].cast("bigint") * FILL_COLS

    def lower(x: Column) -> Column:
        side = F.greatest(first(x) - c, c - (first(x) + FILL_COLS - 1), F.lit(0).cast("bigint"))
        return side * side + x["d"]

    def upper(x: Column) -> Column:
        side = F.greatest(F.abs(first(x) - c), F.abs(first(x) + FILL_COLS - 1 - c))
        return side * side + x["d"]

    bounded = near.where("gap").join(reach, ["scene", "row"]).withColumn("_most", F.array_min(F.transform("_reach", upper)))
    asks = bounded.select(*KEY, F.col("_cb").alias("_gcb"), F.explode(F.filter("_reach", lambda x: lower(x) <= F.col("_most"))["_cb"]).alias("_cb"))
    tile = ["scene", "_rb", "_cb", "_gcb"]
    asks = cut(asks.withColumn("_rb", F.floor(F.col("row") / FILL_ROWS).cast("int")))
    wanted = asks.select(*tile).distinct()
    sources = near.where("_s is not null").withColumn("_rb", F.floor(F.col("row") / FILL_ROWS).cast("int"))
    sources = sources.select("scene", "_rb", "_cb", "row", "col", F.col("_s.row").alias("r"), F.col("_s.v").alias("v"), F.col("_s.a").alias("a"))
    sources = sources.join(wanted, ["scene", "_rb", "_cb"])
    sources = sources.select(*[F.col(c).alias(f"s{c}") for c in tile], "row", "col", "r", "v", "a")
    answers = asks.groupBy(*tile).cogroup(sources.groupBy(*[f"s{c}" for c in tile])).applyInPandas(_answer, "scene bigint, row int, col int, d bigint, r int, c int, v double, a double")
    one = answers.groupBy(*KEY).agg(F.min(F.struct("d", "r", "c", "v", "a")).alias("_b"))
    fills = one.select(*KEY, F.col("_b.v").alias("_fv"), F.col("_b.a").alias("_fa"))
    out = meet(cells, fills, how="left").withColumn("filled", F.col("v").isNull() & F.col("_fv").isNotNull())
    if also:
        out = out.withColumn(also, F.when(F.col("v").isNull(), F.col("_fa")).otherwise(F.col(also)))
    return out.withColumn("v", F.coalesce("v", "_fv")).drop("_fv", "_fa")


def _answer(asks: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """For each asking gap the best source of one tile's stretch of its row: nearest, then smallest row, then column."""
    parts = []
    by_row = dict(tuple(sources.sort_values(["row", "r", "col"], kind="stable").groupby("row")))
    for row, own in asks.groupby("row"):
        src = by_row.get(row)
        if src is None:
            continue
        col, r = src["col"].to_numpy(np.int64), src["r"].to_numpy(np.int64)
        drop2 = (r - row) ** 2
        at = own["col"].to_numpy(np.int64)
        cost = (at[:, None] - col[None, :]) ** 2 + drop2[None, :]
        pick = cost.argmin(axis=1)  # sources are in the order that decides ties
        parts.append(pd.DataFrame({"scene": own["scene"].iloc[0], "row": row, "col": at, "d": cost[np.arange(len(at)), pick], "r": r[pick], "c": col[pick],
                                   "v": src["v"].to_numpy()[pick], "a": src["a"].to_numpy()[pick]}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["scene", "row", "col", "d", "r", "c", "v", "a"])
