"""Text rules: tile paths, elevation-source names, datums, degree tiles, report numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col

# Elevation sources by path text (first match wins), their datums, tile-name form.
SOURCE_RULES = [("carto", "cartodem"), ("copernicus", "copernicus_glo30"), ("nasadem", "nasadem"), ("srtm", "srtm")]
DATUMS = {
    "copernicus_glo30": "EGM2008",
    "cartodem": "WGS84 ellipsoid (measured, V3R1)",
    "srtm": "EGM96",
    "nasadem": "EGM96",
}
CONVERTED_DATUM = "EGM2008 (converted from the WGS84 ellipsoid)"
ELLIPSOIDAL_SOURCES = ["cartodem"]
DEGREE_TILE_FORMAT = "Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM"
# Report labels in display order.
LANDSCAPE_ORDER = ["urban", "sparse", "hilly", "forested", "all"]
METHOD_LABELS = {"dem_only": "DEM only", "method_a": "Method A", "method_b": "Method B"}
MISSING_MARK = "–"


def parse_tile(path) -> Column:
    """``dataset/site/r_c`` to struct<dataset,site,r,c,city>; city = site text before ``_``."""
    path = as_col(path)
    last = F.substring_index(path, "/", -1)
    stem = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    site = F.substring_index(stem, "/", -1)
    rc = r"^(\d+)_(\d+)$"

    def number(group):
        text = F.regexp_extract(last, rc, group)
        return F.when(text != "", text).cast("int")

    return F.struct(
        F.substring_index(path, "/", 1).alias("dataset"), site.alias("site"), number(1).alias("r"),
        number(2).alias("c"), F.substring_index(last, "_", 1).alias("city"), stem.alias("scene"),
    )


def infer_source(path) -> Column:
    """C11: source name from a file path (folder names count), else from the tile-name form, else
    the file stem."""
    path = as_col(path)
    low = F.lower(path)
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.when(F.instr(F.substring(name, 2, 100000), ".") > 0, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for text, source in SOURCE_RULES:
        rule = rule.when(F.contains(low, F.lit(text)), source)
    rule = rule.when(F.lower(stem).rlike(r"^cdn.\d\d.$"), "cartodem")
    return rule.otherwise(stem)


def datum_of(source) -> Column:
    """C11: vertical datum of a known source, else ``unknown``."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, datum in DATUMS.items():
        out = out.when(as_col(source) == name, datum)
    return out.otherwise("unknown")


def degree_tiles(df: DataFrame, w: str, s: str, e: str, n: str) -> DataFrame:
    """A10: one row per 1x1 degree tile touched by the bounds, named after its south-west corner."""

    def span(lo, hi):
        lo, hi = F.floor(lo).cast("int"), F.ceil(hi).cast("int") - 1
        return F.explode(F.when(hi >= lo, F.sequence(lo, hi)))

    out = df.withColumn("tile_lat", span(F.col(s), F.col(n)))
    out = out.withColumn("tile_lon", span(F.col(w), F.col(e)))
    return out.withColumn("tile_name", degree_tile_name("tile_lat", "tile_lon"))


def degree_tile_name(lat, lon) -> Column:
    lat, lon = as_col(lat), as_col(lon)
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string(DEGREE_TILE_FORMAT, ns, F.abs(lat), ew, F.abs(lon))


def fixed_digits(value, digits: int) -> Column:
    """Fixed-digit text of the number's exact binary value, ties to even.

    The built-in formatter rounds the shortest decimal form half up, so 249.845 (stored slightly
    below) would become 249.85. Here the product with 10^digits is split into its rounded value and
    its exact remainder, and the remainder settles ties.
    """
    v, unit = F.abs(as_col(value)), float(10**digits)
    high = v * 134217729.0 - (v * 134217729.0 - v)  # upper half of the mantissa
    prod = v * unit
    rest = (high * unit - prod) + (v - high) * unit
    low = F.floor(prod)
    part = prod - low
    even = F.when(low % 2 == 0, low).otherwise(low + 1)
    tie = F.when(rest > 0, low + 1).when(rest < 0, low).otherwise(even)
    n = F.when(part > 0.5, low + 1).when(part < 0.5, low).otherwise(tie)
    text = F.concat(
        F.when(as_col(value) < 0, "-").otherwise(""), F.floor(n / unit).cast("string"), F.lit("."),
        F.lpad((n % int(unit)).cast("string"), digits, "0"),
    )
    plain = F.when(v.isNotNull(), F.format_string(f"%.{digits}f", as_col(value)))
    return F.when(v < 1e12, text).otherwise(plain)


def fmt(value, digits: int = 2) -> Column:
    """C20: fixed-digit text, a dash for missing."""
    return F.coalesce(fixed_digits(value, digits), F.lit(MISSING_MARK))


def order_of(c, names: list[str]) -> Column:
    """Display position of a label (NULL when it is not shown)."""
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), as_col(c))
    return F.when(pos > 0, pos).cast("int")


def method_label(c) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, label in METHOD_LABELS.items():
        out = out.when(as_col(c) == key, label)
    return out
