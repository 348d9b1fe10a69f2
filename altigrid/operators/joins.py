"""Cell joins and dimension joins (group D, except the resampling joins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.functions import geo
from altigrid.functions.numbers import as_col
from altigrid.model import KEY, attach, cut, cut_measured, finite, meet
from altigrid.sources.strips import beside, cells_of, is_strips

RANGE_BUCKET = 256
FEW_SITES = 20_000
PLACE = "_place"
ALIGNMENT_FIELDS = ["width", "height", "pixel_size_m", "units", "crs", "bounds"]


def join_cells(a: DataFrame, b: DataFrame, how: str = "inner", names=("pred", "ref")) -> DataFrame:
    """Two grids side by side on the cell key. The key is unique per side, so no hot key.

    Each side is a cell table or the strips of a stored grid (:mod:`altigrid.sources.strips`); two stored
    grids meet without a shuffle.
    """
    return beside({names[0]: a, names[1]: b}, how)


def valid_pairs(df: DataFrame, pred: str, ref: str, mask: Column | None = None) -> DataFrame:
    """Keep rows where both sides are finite (and the mask holds)."""
    keep = finite(pred).isNotNull() & finite(ref).isNotNull()
    return df.where(keep if mask is None else keep & mask)


def cells_in_tiles(cells: DataFrame, tiles: DataFrame, bucket: int = RANGE_BUCKET) -> DataFrame:
    """Rectangles x cells. ``tiles`` has ``scene, tile, row0, row1, col0, col1`` (inclusive).

    A tile is listed under each ``bucket`` square it touches, a cell under its own, so the range
    condition becomes an equi-join on (scene, bucket) and a hot scene spreads over its buckets.
    """
    b = F.lit(bucket)
    spans = (
        tiles.withColumn("_br", F.explode(F.sequence(F.floor(F.col("row0") / b), F.floor(F.col("row1") / b))))
        .withColumn("_bc", F.explode(F.sequence(F.floor(F.col("col0") / b), F.floor(F.col("col1") / b))))
    )
    keyed = cells.withColumn("_br", F.floor(F.col("row") / b)).withColumn("_bc", F.floor(F.col("col") / b))
    inside = (
        F.col("row").between(F.col("row0"), F.col("row1")) & F.col("col").between(F.col("col0"), F.col("col1"))
    )
    return keyed.join(spans, ["scene", "_br", "_bc"]).where(inside).drop("_br", "_bc")


def tile_rectangles(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixel rectangle of each tile from the two affine origins on a shared pixel grid.

    ``tiles``: scene, tile, c, f, h, w. ``scenes``: scene, a, c, e, f. Offsets round half to even.
    """
    s = scenes.select("scene", F.col("a").alias("_a"), F.col("e").alias("_e"), F.col("c").alias("_c"), F.col("f").alias("_f"))
    t = tiles.join(s, "scene")
    col0 = F.rint((F.col("c") - F.col("_c")) / F.col("_a")).cast("int")
    row0 = F.rint((F.col("f") - F.col("_f")) / F.col("_e")).cast("int")
    return t.select(
        "scene", "tile", row0.alias("row0"), (row0 + F.col("h") - 1).alias("row1"),
        col0.alias("col0"), (col0 + F.col("w") - 1).alias("col1"),
    )


def join_footprints(items: DataFrame, sites: DataFrame, cell_deg: float = 1.0, by_cell: bool = True) -> DataFrame:
    """Bounding boxes of items that intersect bounding boxes of sites.

    Both sides carry ``west, south, east, north`` in degrees. Boxes are listed under the degree
    cells they touch and met by equi-join; a pair is kept only in the first cell both touch, so no
    de-duplication pass is needed. They meet sorted and merged, also where one side could be broadcast:
    so the items of a cell come together, each with the same sites in the same order, and the pairs, which may
    be many times the input, are stored in a small part of the room. Without ``by_cell`` the planner chooses how they meet.
    """

    def cell(c):
        return F.floor(c / F.lit(cell_deg)).cast("int")

    def listed(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{p}{c}") if c in ("west", "south", "east", "north") else F.col(c) for c in df.columns])
        return out.withColumn(
            "_gx", F.explode(F.sequence(cell(F.col(f"{p}west")), cell(F.col(f"{p}east"))))
        ).withColumn("_gy", F.explode(F.sequence(cell(F.col(f"{p}south")), cell(F.col(f"{p}north")))))

    spread = listed(sites, "s_")
    both = listed(items, "i_").join(spread.hint("merge") if by_cell else spread, ["_gx", "_gy"])
    meet = (
        (F.col("i_west") <= F.col("s_east")) & (F.col("s_west") <= F.col("i_east"))
        & (F.col("i_south") <= F.col("s_north")) & (F.col("s_south") <= F.col("i_north"))
    )
    first = (F.col("_gx") == cell(F.greatest("i_west", "s_west"))) & (
        F.col("_gy") == cell(F.greatest("i_south", "s_south"))
    )
    return both.where(meet & first).drop("_gx", "_gy")


def site_squares(sites: DataFrame, size_px: int, res: float, origin_x: float, origin_y: float) -> DataFrame:
    """Square of ``size_px`` cells around each site, snapped to the source pixel grid.

    ``sites``: lon, lat, epsg. Adds the corner ``left_x, top_y`` in metres and the degree box
    ``west, south, east, north`` of the four corners.
    """
    half = size_px / 2.0 * res
    d = geo.add_utm(sites, "lon", "lat", "epsg", "_x", "_y")
    d = d.withColumn("left_x", origin_x + F.rint((F.col("_x") - half - origin_x) / res) * res)
    d = d.withColumn("top_y", origin_y + F.rint((F.col("_y") + half - origin_y) / res) * res).drop("_x", "_y")
    side = size_px * res
    for i, (dx, dy) in enumerate(((0, 0), (side, 0), (side, -side), (0, -side))):
        d = d.withColumn("_px", F.col("left_x") + dx).withColumn("_py", F.col("top_y") + dy)
        d = geo.add_lonlat(d, "_px", "_py", "epsg", f"_lon{i}", f"_lat{i}")
    lons, lats = [f"_lon{i}" for i in range(4)], [f"_lat{i}" for i in range(4)]
    d = d.withColumn("west", F.least(*lons)).withColumn("east", F.greatest(*lons))
    d = d.withColumn("south", F.least(*lats)).withColumn("north", F.greatest(*lats))
    return d.drop("_px", "_py", *lons, *lats)


def latest_year(items: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Items of the most recent year of their site.

    The newest year is a combinable aggregate joined back, so a site with most of the items is not
    pulled into one window partition.
    """
    newest = items.groupBy(*by).agg(F.max(F.year(ts)).alias("year"))
    return attach(items, newest, by).where(F.year(ts) == F.col("year"))


def newest_footprints(items: DataFrame, sites: DataFrame, ts: str = "ts") -> DataFrame:
    """D4 and D5 in one: per site (``scene``) the intersecting items of its most recent year.

    The newest year of a site is found first and stored beside its box, so that the pairs, of which there may be many
    times the input, are never shuffled and those of older years end where they arise. A stored list of few sites is
    broadcast, as the planner sees by its size; many are merged with the items cell by cell. Runs when called.
    """
    stored, seen = cut_measured(sites, F.count(F.lit(1)).alias("rows"))
    by_cell = seen["rows"] > FEW_SITES
    boxes = items.select("west", "south", "east", "north", F.year(ts).alias("_year"))
    newest = join_footprints(boxes, stored, by_cell=by_cell).groupBy("scene").agg(F.max("_year").alias("_newest"))
    dated = cut(stored.join(newest, "scene"))
    return join_footprints(items, dated, by_cell=by_cell).where(F.year(ts) == F.col("_newest")).drop("_newest")


def number_layers(layers: DataFrame, order: str = "priority", tie: str = "layer") -> DataFrame:
    """Adds ``_place``, a layer's place in its scene by ``order`` and ``tie``, to a table with one row per layer.

    Cells made of it that keep the column are put together by :func:`mosaic` and :func:`mosaic_images` without a join. A layer
    without ``order`` or ``tie`` gets no place and is never chosen.
    """
    known = F.col(order).isNotNull() & F.col(tie).isNotNull()
    return layers.withColumn(PLACE, F.when(known, F.dense_rank().over(Window.partitionBy("scene").orderBy(order, tie))))


def mosaic(layers: DataFrame, order: str = "priority", tie: str = "layer") -> DataFrame:
    """Per cell the first non-missing value in ``order`` (ties: smallest ``tie``).

    The layers' places in that order are numbered first (one stored row per layer of a scene), so that
    the choice is a hash aggregate of two numbers. Cells missing in every layer stay NULL. For a
    newest-first mosaic pass a descending key (for example the negated end time). Cells that bring
    the places of :func:`number_layers` are neither listed nor joined.
    """
    code = F.when(finite("v").isNotNull(), F.col(PLACE))
    if PLACE in layers.columns:
        return layers.groupBy(*KEY).agg(F.min_by("v", code).alias("v"), F.min_by(tie, code).alias("layer_used"))
    places = layer_places(layers, order, tie)
    x = attach(layers.select(*KEY, "v", order, tie), places, ["scene", order, tie], how="left")
    best = x.groupBy(*KEY).agg(F.min_by("v", code).alias("v"), F.min(code).alias("_place"))
    names = places.select("scene", "_place", F.col(tie).alias("layer_used"))
    return attach(best, names, ["scene", "_place"], how="left").select(*KEY, "v", "layer_used")


def layer_places(layers: DataFrame, order: str, tie: str) -> DataFrame:
    """Stored: the distinct ``order`` and ``tie`` of every scene, numbered as ``_place``. A layer without either is never chosen."""
    keys = layers.select("scene", order, tie).where(F.col(order).isNotNull() & F.col(tie).isNotNull()).distinct()
    return cut(keys.withColumn("_place", F.row_number().over(Window.partitionBy("scene").orderBy(order, tie))))


def mosaic_report(cells: DataFrame) -> DataFrame:
    """Covered share of each mosaic with its verdict: error at 0, warning under 1."""
    share = F.avg(F.col("v").isNotNull().cast("double"))
    return cells.groupBy("scene").agg(share.alias("coverage")).withColumn(
        "status", F.when(F.col("coverage") == 0, "error").when(F.col("coverage") < 1, "warning").otherwise("ok")
    )


def mosaic_images(layers: DataFrame, min_coverage: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """First image with any non-zero band wins each cell.

    ``layers``: scene, row, col, item, priority, r, g, b. Returns the cells of scenes that are
    covered enough and a per-scene report with the covered share and the ids actually used. Cells that bring the
    places of :func:`number_layers` are not joined with them, and their mosaic is stored for both results.
    """
    lit = (F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)
    code = F.when(lit, F.col(PLACE))
    best = [F.min(code).alias(PLACE), *[F.min_by(c, code).alias(c) for c in "rgb"]]
    if PLACE in layers.columns:
        cells = cut(layers.groupBy(*KEY).agg(*best, F.min_by("item", code).alias("item")))
        places = cells.where(F.col(PLACE).isNotNull()).select("scene", PLACE, "item").distinct()
    else:
        places = layer_places(layers, "priority", "item")
        cells = attach(layers, places, ["scene", "priority", "item"], how="left").groupBy(*KEY).agg(*best)
    share = cells.groupBy("scene").agg(F.avg(F.col("_place").isNotNull().cast("double")).alias("coverage"))
    used = (
        cells.where(F.col("_place").isNotNull()).select("scene", "_place").distinct().join(places, ["scene", "_place"]).groupBy("scene")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "item"))), lambda s: s["item"].cast("string")), ",").alias("items_used"))
    )
    report = share.join(used, "scene", "left").withColumn("accepted", F.col("coverage") >= min_coverage)
    kept = attach(cells, report.where("accepted").select("scene"), how="left_semi")
    zero = F.lit(0)
    out = kept.select(*KEY, *[F.coalesce(F.col(c), zero).alias(c) for c in "rgb"])
    return out, report


def apply_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells listed in ``mask`` become missing. A stored mask lists the cells that have a value."""
    if is_strips(cells) and is_strips(mask):
        both = beside({"v": cells, "_masked": mask}, "left")
    else:
        flag = (cells_of(mask).where("v IS NOT NULL") if is_strips(mask) else mask).select(*KEY, F.lit(True).alias("_masked"))
        both = meet(cells_of(cells) if is_strips(cells) else cells, flag, how="left")
    return both.withColumn("v", F.when(F.col("_masked").isNull(), F.col("v"))).drop("_masked")


def canonical(value: Column) -> Column:
    """JSON text of a typed value: fields stand in the schema's order, whatever the order in the source text."""
    return F.to_json(F.struct(value.alias("v")))


def check_alignment(base: DataFrame, ref: DataFrame, on: str = "scene", fields: list[str] | None = None) -> DataFrame:
    """Name of the first metadata field on which two grids differ (NULL = aligned).

    ``base`` and ``ref`` hold one typed metadata row per grid (parsed with the fixed schema, which
    makes the JSON key order irrelevant). Missing equals missing.
    """
    fields = fields or ALIGNMENT_FIELDS
    b = base.select(on, *[canonical(F.col(f)).alias(f"b_{f}") for f in fields])
    r = ref.select(on, *[canonical(F.col(f)).alias(f"r_{f}") for f in fields])
    verdict = reduce(
        lambda acc, f: F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"r_{f}")), f).otherwise(acc),
        reversed(fields),
        F.lit(None).cast("string"),
    )
    return b.join(r, on).select(on, verdict.alias("mismatch"))


def enrich(df: DataFrame, dim: DataFrame, on: str, defaults: dict[str, str]) -> DataFrame:
    """Left join of descriptive columns with a default text where there is none."""
    joined = df.join(dim, on, "left")
    for name, text in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(text)))
    return joined


def apply_palette(cells: DataFrame, palette: DataFrame, index: str = "v") -> DataFrame:
    """Colour index to RGB; an index without an entry is black.

    A palette has at most 256 entries (the index is one byte), so it is safe to broadcast.
    """
    entries = F.broadcast(palette.where(F.col("idx").between(0, 255)).dropDuplicates(["idx"]))
    joined = cells.join(entries, cells[index].cast("int") == entries["idx"], "left").drop("idx")
    return joined.select(
        *[c for c in joined.columns if c not in ("r", "g", "b")],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "rgb"],
    )


def join_three(a: DataFrame, b: DataFrame, n: DataFrame) -> DataFrame:
    """Two elevation models and a geoid on one grid, rows valid in all three."""
    x = beside({"a": a, "b": b, "n": n}).select(*KEY, *[finite(c).alias(c) for c in "abn"])
    return x.where("a IS NOT NULL AND b IS NOT NULL AND n IS NOT NULL")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell-wise ``a - b``; missing on either side is missing."""
    return join_cells(a, b, names=("a", "b")).select(*KEY, (F.col("a") - F.col("b")).alias("v"))


def to_relative_units(ref: DataFrame, fit: DataFrame) -> DataFrame:
    """Reference heights in a relative grid's units: ``(ref - align_b) / align_a`` per scene."""
    return attach(ref, fit.select("scene", "align_a", "align_b")).select(
        *KEY, F.try_divide(F.col("v") - F.col("align_b"), F.col("align_a")).alias("v")
    )


def last_per(df: DataFrame, by: list[str], order: Column | str, keep: list[str]) -> DataFrame:
    """Row with the greatest ``order`` of every group as a combinable aggregate (no window)."""
    top = F.max(F.struct(as_col(order).alias("_o"), *keep))
    return df.groupBy(*by).agg(top.alias("_t")).select(*by, *[F.col(f"_t.{c}").alias(c) for c in keep])


