"""Resampling (R1-R4) and point sampling.

Values between cells are looked up with one equi-join: every source cell already carries its
neighbours (one block shuffle of the source), so target cells are neither multiplied by the kernel
size nor summed up again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.functions import geo
from altigrid.functions.numbers import as_col, half_up
from altigrid.functions.terrain import slope_degrees, unit_normal, uv
from altigrid.model import KEY, attach, cut_measured, scene_extent, meet
from altigrid.operators.neighbourhood import corners, patch4

WEIGHT_FLOOR = 1e-10  # fixed value: lighter neighbours are ignored, even missing ones
PROFILE_POINTS = 2048
MIN_VALID_FRACTION = 0.5


def grid_frame(dims: DataFrame) -> DataFrame:
    """All cells of grids given as ``scene, h, w`` (plus columns to carry).

    Rows are spread over the cluster before columns are generated, so one huge scene does not grow
    in a single task.
    """
    rows = dims.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)))
    rows = rows.repartition("scene", "row")
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)))


def _weighted(terms: list[tuple[Column, Column]]) -> Column:
    """Sum of weight x value; a missing value with a real weight makes the result missing."""
    parts = [F.when(w > WEIGHT_FLOOR, w * v).otherwise(0.0) for w, v in terms]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def bilinear_at(cells: DataFrame, at: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """Adds the bilinear value of ``cells`` at cell-index coordinates (``y`` down, ``x`` right)."""
    c = corners(cells).select(
        "scene", F.col("row").alias("_y0"), F.col("col").alias("_x0"), F.lit(True).alias("_hit"), "v00", "v01", "v10", "v11"
    )
    p = at.withColumn("_y0", F.floor(y).cast("int")).withColumn("_x0", F.floor(x).cast("int"))
    j = meet(p, c, ["scene", "_y0", "_x0"], "left")
    ty, tx = F.col(y) - F.col("_y0"), F.col(x) - F.col("_x0")
    value = _weighted(
        [((1 - tx) * (1 - ty), F.col("v00")), (tx * (1 - ty), F.col("v01")), ((1 - tx) * ty, F.col("v10")), (tx * ty, F.col("v11"))]
    )
    return j.withColumn(out, F.when(F.col("_hit"), value)).drop("_y0", "_x0", "_hit", "v00", "v01", "v10", "v11")


def look_up(cells: DataFrame, points: DataFrame, y: str, x: str, out: str, gradient: bool = False, strict: bool = False, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """Values at points: adds ``out``, with ``gradient`` also the neighbour steps ``_dx, _dy`` and their cell
    distances ``_nx, _ny`` at the nearest cell. ``more`` names further grids of the same scenes whose values are added.

    The cells above left of the points are listed first, each once however many points lie below it, and stored with
    their neighbours, so the planner knows the list's true size (a short list is broadcast, the grid is then read once
    and not shuffled) and the grid scan is narrowed to the rows and scenes the points touch. The points themselves are
    shuffled once at most, for all grids.

    With ``strict`` (``points`` then have ``h, w``) all four cells around a point must be there, those of weight
    0 too; for a point on the last row or column of centres the one before it takes the place of what lies beyond.
    """
    y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    dy, dx = F.lit(1), F.lit(1)
    if strict:
        dy, dx = (F.when((F.col(p) == F.floor(p)) & (a + 1 == F.col(n)), F.greatest(F.col(n) - 2, F.lit(0)) - a).otherwise(1) for p, a, n in ((y, y0, "h"), (x, x0, "w")))
    zero = F.lit(0)
    wanted = [("p00", zero, zero), ("p01", zero, dx), ("p10", dy, zero), ("p11", dy, dx)]
    if gradient:
        r, c = half_up(y).cast("int") - y0, half_up(x).cast("int") - x0
        wanted += [("c", r, c), ("e", r, c + 1), ("w", r, c - 1), ("s", r + 1, c), ("n", r - 1, c)]
    lo, hi = (-1 if gradient or strict else 0), (2 if gradient else 1)
    side = hi - lo + 1
    offsets = [(r, c) for r in range(lo, hi + 1) for c in range(lo, hi + 1) if strict or not (r in (-1, 2) and c in (-1, 2))]
    at = ["scene", "_y0", "_x0"]
    spots = points.withColumn("_y0", y0).withColumn("_x0", x0)
    slots = F.array(*[F.struct(F.lit((r - lo) * side + c - lo).alias("slot"), F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    keys = spots.select(at).distinct().withColumn("_s", F.explode(slots))
    keys = keys.select(*at, "_s.slot", (F.col("_y0") + F.col("_s.r")).alias("row"), (F.col("_x0") + F.col("_s.c")).alias("col"))
    edges = [f(c).alias(f"{n}_{c}") for c in KEY for n, f in (("lo", F.min), ("hi", F.max))]
    keys, box = cut_measured(keys, *edges)
    for name, grid in {out: cells, **(more or {})}.items():
        near = grid.select(*KEY, "v")
        for c in KEY:
            if box[f"lo_{c}"] is not None:
                near = near.where(F.col(c).between(box[f"lo_{c}"], box[f"hi_{c}"]))
        own = [F.col("slot") == i for i in range(side * side)]
        got = keys.join(near, KEY).groupBy(at).agg(*[
            a for i, mine in enumerate(own) for a in (F.max(F.when(mine, F.col("v"))).alias(f"_v{i}"), F.max(mine.cast("int")).alias(f"_has{i}"))
        ])
        got = got.select(*at, F.array(*[f"_v{i}" for i in range(len(own))]).alias("_v"), F.array(*[f"_has{i}" for i in range(len(own))]).alias("_has"))
        spots = spots.join(got, at, "left")
        use = wanted if name == out else wanted[:4]
        for n, r, c in use:
            i = (r - lo) * side + (c - lo)
            spots = spots.withColumn(f"_v_{n}", F.get("_v", i)).withColumn(f"_has_{n}", F.get("_has", i))
        spots = _from_slots(spots.drop("_v", "_has"), [n for n, _, _ in use], y, x, name, strict)
    return spots.drop("_y0", "_x0")


def _from_slots(j: DataFrame, slots: list[str], y: str, x: str, out: str, strict: bool = False) -> DataFrame:
    """Bilinear value (and steps, where their cells are there) from the cells around a point, as ``_v_`` and ``_has_`` columns."""
    ty, tx = F.col(y) - F.floor(y), F.col(x) - F.floor(x)
    terms = [((1 - tx) * (1 - ty), F.col("_v_p00")), (tx * (1 - ty), F.col("_v_p01")), ((1 - tx) * ty, F.col("_v_p10")), (tx * ty, F.col("_v_p11"))]
    value = sum(w * v for w, v in terms) if strict else _weighted(terms)
    j = j.withColumn(out, F.when(F.col("_has_p00") == 1, value))
    if "c" in slots:
        for axis, lo, hi in (("x", "w", "e"), ("y", "n", "s")):
            first = F.when(F.col(f"_has_{lo}") == 1, F.col(f"_v_{lo}")).otherwise(F.col("_v_c"))
            last = F.when(F.col(f"_has_{hi}") == 1, F.col(f"_v_{hi}")).otherwise(F.col("_v_c"))
            j = j.withColumn(f"_d{axis}", last - first).withColumn(f"_n{axis}", F.col(f"_has_{lo}") + F.col(f"_has_{hi}"))
    return j.drop(*[f"_v_{n}" for n in slots], *[f"_has_{n}" for n in slots])


#: Cells around a point: how far down and right of the cell above left of it, or of its nearest cell.
BASE_SLOTS = {"p00": (0, 0), "p01": (0, 1), "p10": (1, 0), "p11": (1, 1)}
NEAR_SLOTS = {"c": (0, 0), "e": (0, 1), "w": (0, -1), "s": (1, 0), "n": (-1, 0)}


def vertex_stencils(cells: DataFrame, dims: DataFrame, gradient: bool) -> DataFrame:
    """The cells around every vertex of display grids: ``scene, r, c`` with ``_v_`` and ``_has_`` columns.

    ``dims``: scene, ``_h, _w`` (cells) and ``h, w`` (vertices, no more than cells or two). Each cell finds the
    vertices it serves by the inverse of their positions, at most a few per axis; cells that serve none are
    filtered in the scan, and the parts of a stencil combine before the shuffle.
    """
    x = attach(cells.select(*KEY, "v"), dims.select("scene", "h", "w", "_h", "_w"))
    axes = (("row", "r", "h", "_h"), ("col", "c", "w", "_w"))
    for pos, vertex, n, size in axes:
        step = (F.col(n) - 1) / F.greatest(F.col(size) - 1, F.lit(1))
        whole = F.col(size) == 1
        # a vertex lies within one and a half cells of all that it uses; the slack covers rounding
        lo = F.when(whole, 0).otherwise(F.greatest(F.ceil((F.col(pos) - 1.5) * step - 1e-6), F.lit(0)))
        hi = F.when(whole, F.col(n) - 1).otherwise(F.least(F.floor((F.col(pos) + 1.5) * step + 1e-6), F.col(n) - 1))
        x = x.withColumn(f"_lo{vertex}", lo.cast("int")).withColumn(f"_hi{vertex}", hi.cast("int"))
    x = x.where("_lor <= _hir AND _loc <= _hic")
    for pos, vertex, n, size in axes:
        x = x.withColumn(vertex, F.explode(F.sequence(f"_lo{vertex}", f"_hi{vertex}")))
        at = F.col(vertex) / (F.col(n) - 1) * (F.col(size) - 1)
        x = x.withColumn(f"_b{vertex}", F.col(pos) - F.floor(at).cast("int")).withColumn(f"_n{vertex}", F.col(pos) - half_up(at).cast("int"))
    slots = {s: (F.col("_br") == dr) & (F.col("_bc") == dc) for s, (dr, dc) in BASE_SLOTS.items()}
    if gradient:
        slots |= {s: (F.col("_nr") == dr) & (F.col("_nc") == dc) for s, (dr, dc) in NEAR_SLOTS.items()}
    aggs = [a for s, own in slots.items() for a in (F.max(F.when(own, F.col("v"))).alias(f"_v_{s}"), F.max(own.cast("int")).alias(f"_has_{s}"))]
    return x.groupBy("scene", "r", "c").agg(*aggs)


def _with_gradient(df: DataFrame, px: Column) -> DataFrame:
    """``gx, gy`` from the steps of :func:`look_up`, NULL unless both are known."""
    gx, gy = F.try_divide(F.col("_dx"), F.col("_nx") * px), F.try_divide(F.col("_dy"), F.col("_ny") * px)
    known = gx.isNotNull() & gy.isNotNull()
    return df.withColumn("gx", F.when(known, gx)).withColumn("gy", F.when(known, gy)).drop("_dx", "_dy", "_nx", "_ny")


def sample_points(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Value at control points given in pixel coordinates (cell centres at .5).

    Points outside the grid are dropped; between the outermost centres and the grid edge there is
    no value, nor where one of the four cells around the point is missing, even one of weight 0 (a point on
    a cell's centre beside a gap).
    """
    p = points.withColumn("_y", F.col("row_f") - 0.5).withColumn("_x", F.col("col_f") - 0.5)
    ext = scene_extent(cells)
    p = attach(p, ext)
    p = p.where((F.col("col_f") >= 0) & (F.col("col_f") < F.col("w")) & (F.col("row_f") >= 0) & (F.col("row_f") < F.col("h")))
    return look_up(cells, p, "_y", "_x", "value", strict=True).drop("_y", "_x", "h", "w")


def bilinear(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``height`` at fractional cell-index coordinates ``row_f, col_f`` (NULL outside)."""
    return look_up(cells, points, "row_f", "col_f", "height")


def inspect(cells: DataFrame, points: DataFrame, ref: DataFrame | None = None, px=1.0) -> DataFrame:
    """Height, slope at the nearest cell and error against a reference at each point."""
    px = as_col(px) if isinstance(px, (str, Column)) else F.lit(float(px))
    more = {} if ref is None else {"_ref": ref}
    out = _with_gradient(look_up(cells, points, "row_f", "col_f", "height", gradient=True, more=more), px)
    out = out.withColumn("slope", F.when(F.col("height").isNotNull(), slope_degrees("gx", "gy"))).drop("gx", "gy")
    if ref is None:
        return out.withColumn("error", F.lit(None).cast("double"))
    return out.withColumn("error", F.col("height") - F.col("_ref")).drop("_ref")


def profile_points(lines: DataFrame, px=1.0, most: int = PROFILE_POINTS) -> DataFrame:
    """Evenly spaced points along ``scene, line, c0, r0, c1, r1`` with their plan distance.

    A line has a point per cell of its length, both ends included, and ``most`` at most: a longer line is
    sampled more coarsely.
    """
    px = as_col(px) if isinstance(px, (str, Column)) else F.lit(float(px))
    dc, dr = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    cells = F.hypot(dc, dr)
    count = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(cells) + 1)).cast("int")
    p = lines.withColumn("_n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("i") / (F.col("_n") - 1)
    return p.select(
        "scene", "line", "i", (F.col("c0") + dc * t).alias("col_f"), (F.col("r0") + dr * t).alias("row_f"),
        (cells * px * t).alias("distance"),
    )


def profile(cells: DataFrame, lines: DataFrame, px=1.0, ref: DataFrame | None = None, most: int = PROFILE_POINTS) -> DataFrame:
    """Transects sampled with R6, of ``most`` points at most."""
    return inspect(cells, profile_points(lines, px, most), ref, px)


def profile_stats(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Min, max, net change and length per line; the change needs both ends."""
    change = F.max_by("height", "i") - F.min_by("height", "i")
    return points.groupBy(*(by or ["scene", "line"])).agg(
        F.min("height").alias("min_h"), F.max("height").alias("max_h"), change.alias("net_change"),
        F.max("distance").alias("length"),
    )


def _source_position(src: Column, dst: Column) -> Column:
    world = geo.pixel_to_world(dst, F.col("col") + 0.5, F.col("row") + 0.5)
    return geo.world_to_pixel(src, world["x"], world["y"])


def _cubic_spline(t: Column) -> list[Column]:
    """Uniform cubic B-spline weights of the four cells around fraction ``t``."""
    u = 1.0 - t
    return [
        u * u * u / 6.0, (3.0 * t * t * t - 6.0 * t * t + 4.0) / 6.0,
        (3.0 * u * u * u - 6.0 * u * u + 4.0) / 6.0, t * t * t / 6.0,
    ]


def resample(cells: DataFrame, target: DataFrame, kernel: str = "bilinear") -> DataFrame:
    """Values on another grid of the same CRS.

    ``target`` holds one row per scene: ``h, w`` and the affine structs ``src`` and ``dst``. A target
    cell is NULL outside the source or where a neighbour with weight is missing. Plain kernels: no
    smoothing when shrinking (use :func:`area_downsample` for that).
    """
    t = grid_frame(target.select("scene", "h", "w", "src", "dst"))
    pos = _source_position(F.col("src"), F.col("dst"))
    t = t.select(*KEY, pos.alias("_p")).select(*KEY, F.col("_p.row").alias("_y"), F.col("_p.col").alias("_x"))
    if kernel == "nearest":
        t = t.withColumn("_y0", F.floor("_y").cast("int")).withColumn("_x0", F.floor("_x").cast("int"))
        s = cells.select("scene", F.col("row").alias("_y0"), F.col("col").alias("_x0"), "v")
        return meet(t, s, ["scene", "_y0", "_x0"], "left").select(*KEY, "v")
    t = t.withColumn("_y", F.col("_y") - 0.5).withColumn("_x", F.col("_x") - 0.5)
    if kernel == "bilinear":
        return bilinear_at(cells, t, "_y", "_x", "v").select(*KEY, "v")
    if kernel != "cubic_spline":
        raise ValueError(f"Unknown kernel {kernel!r}")
    t = t.withColumn("_y0", F.floor("_y").cast("int")).withColumn("_x0", F.floor("_x").cast("int"))
    s = patch4(cells).select("scene", F.col("row").alias("_y0"), F.col("col").alias("_x0"), "p")
    j = meet(t, s, ["scene", "_y0", "_x0"], "left")
    wy, wx = _cubic_spline(F.col("_y") - F.col("_y0")), _cubic_spline(F.col("_x") - F.col("_x0"))
    terms = [(wy[i] * wx[k], F.col("p")[i][k]) for i in range(4) for k in range(4)]
    return j.withColumn("v", F.when(F.col("p").isNotNull(), _weighted(terms))).select(*KEY, "v")


def area_resize(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Area means onto ``h2`` x ``w2`` grids (``dims``: scene, h, w, h2, w2; not larger than h, w).

    Overlaps are exact integers in units of 1/(w2*h2) cells. Returns ``v`` (mean of the valid part)
    and ``valid_frac``. A source cell reaches at most two targets per axis and the sums combine
    before the shuffle.
    """
    x = attach(cells, dims)

    def long(name: str) -> Column:
        return F.col(name).cast("bigint")

    def targets(pos: str, n: str, n2: str) -> Column:
        p, n, n2 = long(pos), long(n), long(n2)
        return F.explode(F.sequence(F.floor(p * n2 / n), F.floor(((p + 1) * n2 - 1) / n)))

    def overlap(t: str, pos: str, n: str, n2: str) -> Column:
        p, n, n2, t = long(pos), long(n), long(n2), F.col(t)
        return F.least((p + 1) * n2, (t + 1) * n) - F.greatest(p * n2, t * n)

    x = x.withColumn("_ty", targets("row", "h", "h2")).withColumn("_tx", targets("col", "w", "w2"))
    area = (overlap("_ty", "row", "h", "h2") * overlap("_tx", "col", "w", "w2")).cast("double")
    x = x.select("scene", "v", "_ty", "_tx", area.alias("_a"))
    ok = F.when(F.col("v").isNotNull(), F.col("_a")).otherwise(0.0)
    g = x.groupBy("scene", F.col("_ty").cast("int").alias("row"), F.col("_tx").cast("int").alias("col")).agg(
        F.sum(F.col("_a") * F.col("v")).alias("_s"), F.sum(ok).alias("_ok"), F.sum("_a").alias("_all")
    )
    return g.select(*KEY, F.try_divide(F.col("_s"), F.col("_ok")).alias("v"), (F.col("_ok") / F.col("_all")).alias("valid_frac"))


def capped_dims(extent: DataFrame, max_side: int, least: int = 1) -> DataFrame:
    """Output size with the long side at most ``max_side`` (half-even rounding)."""
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("h", "w"))
    return extent.withColumn("h2", F.greatest(F.lit(least), F.rint(F.col("h") * scale)).cast("int")).withColumn(
        "w2", F.greatest(F.lit(least), F.rint(F.col("w") * scale)).cast("int")
    )


def area_downsample(cells: DataFrame, max_side: int, extent: DataFrame | None = None) -> DataFrame:
    """Area mean of the valid cells with the valid share; ``trusted`` when at least half."""
    dims = capped_dims(extent if extent is not None else scene_extent(cells), max_side, 2)
    out = area_resize(cells, dims.select("scene", "h", "w", "h2", "w2"))
    return out.withColumn("trusted", F.col("v").isNotNull() & (F.col("valid_frac") >= MIN_VALID_FRACTION))


def cap_size(cells: DataFrame, scenes: DataFrame, max_side: int = 12000) -> tuple[DataFrame, DataFrame]:
    """Oversize scenes shrink by area mean; transform rescaled, ``downsampled`` says so."""
    dims = capped_dims(scenes, max_side)
    out = area_resize(cells, dims.select("scene", "h", "w", "h2", "w2")).select(*KEY, "v")
    t = geo.scale_transform(F.col("t"), F.col("w") / F.col("w2"), F.col("h") / F.col("h2"))
    meta = dims.withColumn("t", t).withColumn("downsampled", F.greatest("h", "w") > F.greatest("h2", "w2"))
    return out, meta.withColumn("h", F.col("h2")).withColumn("w", F.col("w2")).drop("h2", "w2")


def bilinear_resize(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Bilinear enlargement to ``h`` x ``w`` from ``h2`` x ``w2`` with the border cell held."""
    t = grid_frame(dims.select("scene", "h", "w", "h2", "w2"))

    def pos(p, n, n2):
        x = (F.col(p) + 0.5) * F.col(n2) / F.col(n) - 0.5
        return F.least(F.greatest(x, F.lit(0.0)), F.col(n2) - 1.0)

    t = t.select(*KEY, pos("row", "h", "h2").alias("_y"), pos("col", "w", "w2").alias("_x"))
    return bilinear_at(cells, t, "_y", "_x", "v").select(*KEY, "v")


def enlarge_onto(cells: DataFrame, small: DataFrame, dims: DataFrame, out: str) -> DataFrame:
    """Adds to the cells of a grid the bilinear value of its reduced grid ``small``, as :func:`bilinear_resize` gives it.

    A cell finds its place on the reduced grid by arithmetic, so there is one join, to the reduced grid.
    ``dims``: scene, h, w (cells) and h2, w2 (reduced).
    """
    x = attach(cells, dims.select("scene", *[F.col(c).alias(f"_{c}") for c in ("h", "w", "h2", "w2")]))
    for pos, n, at in (("row", "h", "_y"), ("col", "w", "_x")):
        p = (F.col(pos) + 0.5) * F.col(f"_{n}2") / F.col(f"_{n}") - 0.5
        x = x.withColumn(at, F.least(F.greatest(p, F.lit(0.0)), F.col(f"_{n}2") - 1.0))
    return bilinear_at(small, x, "_y", "_x", out).drop("_y", "_x", "_h", "_w", "_h2", "_w2")


def reproject_to_utm(cells: DataFrame, scenes: DataFrame, edge_points: int = 21) -> tuple[DataFrame, DataFrame]:
    """R2: degree grids onto square metre cells in the UTM zone of their centre.

    ``scenes``: scene, h, w, crs, epsg, t. Grids that are not in degrees pass unchanged, and so do those whose
    centre has no UTM zone (beyond 84 degrees north or 80 south): near a pole the finer side of a cell goes to
    nothing and with it the target's cells beyond any number; past it there is no ground. A centre beyond 180
    degrees east or west is brought back by whole turns. Values are bilinear; ``valid`` follows the nearest
    source cell.
    """
    deg = geo.is_georeferenced("crs", F.col("t")) & (F.col("epsg") == 4326)
    turned = geo.add_center(geo.within_turn(scenes, "t", "h", "w", deg), "t", "epsg", "h", "w")
    zoned = deg & F.col("mid_lat").between(geo.UTM_SOUTH, geo.UTM_NORTH)
    plan = turned.where(zoned).withColumn("_zone", geo.utm_epsg("mid_lon", "mid_lat"))
    own = geo.pixel_to_world(F.col("t"), F.col("w") / 2.0, F.col("h") / 2.0)
    keep = scenes.where(~F.coalesce(deg & own["y"].between(geo.UTM_SOUTH, geo.UTM_NORTH), F.lit(False)))
    plan = geo.add_ground_sides(plan, "t", "epsg", "h", "w").withColumnRenamed("pixel_m", "_res")
    # outline of the grid in the target zone
    k = F.explode(F.sequence(F.lit(0), F.lit(edge_points - 1)))
    edge = plan.withColumn("_k", k).withColumn("_f", F.col("_k") / (edge_points - 1))
    w, h, f = F.col("w"), F.col("h"), F.col("_f")
    sides = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (
        (w * f, F.lit(0.0)), (w * f, h * 1.0), (F.lit(0.0), h * f), (w * 1.0, h * f))]))
    edge = edge.withColumn("_e", sides)
    ll = geo.pixel_to_world(F.col("t"), F.col("_e.x"), F.col("_e.y"))
    edge = edge.withColumn("_lon", ll["x"]).withColumn("_lat", ll["y"]).select("scene", "_zone", "_lon", "_lat")
    box = geo.add_utm(edge, "_lon", "_lat", "_zone", "_ux", "_uy").groupBy("scene").agg(
        F.min("_ux").alias("_l"), F.max("_ux").alias("_r"), F.min("_uy").alias("_b"), F.max("_uy").alias("_t")
    )
    out = plan.join(box, "scene")
    zero = F.lit(0.0)
    dst = F.struct(
        F.col("_res").alias("a"), zero.alias("b"), F.col("_l").alias("c"), zero.alias("d"), (-F.col("_res")).alias("e"), F.col("_t").alias("f")
    )
    out = out.select(
        "scene", F.greatest(F.ceil((F.col("_t") - F.col("_b")) / F.col("_res")), F.lit(1)).cast("int").alias("h"),
        F.greatest(F.ceil((F.col("_r") - F.col("_l")) / F.col("_res")), F.lit(1)).cast("int").alias("w"),
        F.concat(F.lit("EPSG:"), F.col("_zone").cast("string")).alias("crs"), F.col("_zone").alias("epsg"),
        dst.alias("t"), F.col("t").alias("_src"),
    )
    tgt = grid_frame(out)
    world = geo.pixel_to_world(F.col("t"), F.col("col") + 0.5, F.col("row") + 0.5)
    p = tgt.select(*KEY, "_src", "epsg", world["x"].alias("_wx"), world["y"].alias("_wy"))
    p = geo.add_lonlat(p, "_wx", "_wy", "epsg", "_lon", "_lat")
    at = geo.world_to_pixel(F.col("_src"), "_lon", "_lat")
    p = p.select(*KEY, (at["row"] - 0.5).alias("_y"), (at["col"] - 0.5).alias("_x"))
    vals = bilinear_at(cells, p, "_y", "_x", "v")
    near = vals.withColumn("_yn", F.floor(F.col("_y") + 0.5).cast("int")).withColumn("_xn", F.floor(F.col("_x") + 0.5).cast("int"))
    src = cells.select("scene", F.col("row").alias("_yn"), F.col("col").alias("_xn"), F.col("v").isNotNull().alias("valid"))
    moved = meet(near, src, ["scene", "_yn", "_xn"], "left").select(*KEY, "v", F.coalesce("valid", F.lit(False)).alias("valid"))
    same = cells.join(keep.select("scene"), "scene", "left_semi").select(*KEY, "v", F.col("v").isNotNull().alias("valid"))
    return moved.unionByName(same), out.drop("_src").unionByName(keep.select("scene", "h", "w", "crs", "epsg", "t"))


def mesh(cells: DataFrame, scenes: DataFrame, cap: int = 513, ref: DataFrame | None = None, most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Display vertices (at most ``cap`` per side, ``most`` in any case; outer cells kept) and triangles.

    A mesh is for display: a grid with more cells than that is thinned, and heights between vertices are lost.

    ``scenes``: scene, h, w, pixel_m, min_h. A triangle is kept when its three vertices are valid.
    """
    cap = max(2, min(most, math.floor(cap)))
    long = F.greatest("h", "w") - 1
    factor = F.least(F.lit(1.0), F.lit(float(cap - 1)) / long)
    dims = scenes.select(
        "scene", F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("pixel_m").alias("_px"), F.col("min_h").alias("_min"),
        F.greatest(F.lit(2), half_up((F.col("h") - 1) * factor) + 1).cast("int").alias("h"),
        F.greatest(F.lit(2), half_up((F.col("w") - 1) * factor) + 1).cast("int").alias("w"),
    )
    g = grid_frame(dims).withColumnsRenamed({"row": "r", "col": "c"})
    col_f = F.col("c") / (F.col("w") - 1) * (F.col("_w") - 1)
    row_f = F.col("r") / (F.col("h") - 1) * (F.col("_h") - 1)
    g = g.withColumn("col_f", col_f).withColumn("row_f", row_f)
    near = g.join(vertex_stencils(cells, dims, True), ["scene", "r", "c"], "left")
    at = _with_gradient(_from_slots(near, [*BASE_SLOTS, *NEAR_SLOTS], "row_f", "col_f", "height"), F.col("_px"))
    known = F.col("gx").isNotNull()
    gx, gz = F.coalesce("gx", F.lit(0.0)), F.coalesce("gy", F.lit(0.0))
    if ref is not None:
        at = _from_slots(at.join(vertex_stencils(ref, dims, False), ["scene", "r", "c"], "left"), [*BASE_SLOTS], "row_f", "col_f", "_ref")
    else:
        at = at.withColumn("_ref", F.lit(None).cast("double"))
    n, t = unit_normal(gx, gz), uv("row_f", "col_f", "_h", "_w")
    err = F.col("height") - F.col("_ref")
    vertices = at.select(
        "scene", "r", "c", "height", n.alias("_n"), t.alias("_t"), F.col("height").isNotNull().alias("valid"),
        (F.col("col_f") * F.col("_px") - (F.col("_w") - 1) * F.col("_px") / 2).alias("x"),
        (F.coalesce("height", "_min") - F.col("_min")).alias("y"),
        (F.col("row_f") * F.col("_px") - (F.col("_h") - 1) * F.col("_px") / 2).alias("z"),
        F.when(known, slope_degrees(gx, gz)).otherwise(-1.0).alias("slope"),
        F.coalesce(err, F.lit(0.0)).alias("error"), err.isNotNull().alias("error_valid"),
        (F.col("r") * F.col("w") + F.col("c")).alias("vertex"), F.col("w").alias("_cols"),
    ).select("*", "_n.nx", "_n.ny", "_n.nz", "_t.u", F.col("_t.v").alias("t")).drop("_n", "_t")
    return vertices.drop("_cols", "height"), triangles(vertices)


def triangles(vertices: DataFrame) -> DataFrame:
    """Index triples of valid triangles: each vertex offers itself to the triangles that use it."""
    r, c = F.col("r"), F.col("c")
    # a vertex takes part in up to three triangles of each kind; quads are named by their top-left
    roles = [("a", r, c, 0), ("a", r, c - 1, 2), ("a", r - 1, c, 1), ("b", r, c - 1, 0), ("b", r - 1, c, 1), ("b", r - 1, c - 1, 2)]
    use = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), qr.alias("qr"), qc.alias("qc"), F.lit(i).alias("i")) for k, qr, qc, i in roles
    ]))
    offers = vertices.where("valid").select("scene", "vertex", use.alias("q")).where("q.qr >= 0 AND q.qc >= 0")
    corner = [F.max(F.when(F.col("q.i") == i, F.col("vertex"))).alias(f"i{i}") for i in range(3)]
    return offers.groupBy("scene", "q.qr", "q.qc", "q.k").agg(F.count(F.lit(1)).alias("_n"), *corner).where("_n = 3").select(
        "scene", "i0", "i1", "i2"
    )
