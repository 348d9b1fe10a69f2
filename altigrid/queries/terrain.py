"""Checked queries: neighbourhoods, resampling, terrain and profiles."""

from pyspark.sql import functions as F

from altigrid.functions import geo
from altigrid.functions.numbers import rounded
from altigrid.model import attach, scene_extent
from altigrid.operators import metrics, neighbourhood, resample, surface
from altigrid.queries import fixtures as fx
from altigrid.queries.metrics import r6, sql_r
from altigrid.queries.registry import query

KEY = ["scene", "row", "col"]


def grad_sql(src: str, px: float = 1.0) -> str:
    """Relation ``gr`` with gx, gy of ``src`` by self joins on the neighbour positions."""
    return f"""gr AS (SELECT c.scene, c.row, c.col, c.v,
  (CASE WHEN e.scene IS NULL THEN c.v ELSE e.v END - CASE WHEN w.scene IS NULL THEN c.v ELSE w.v END)
    / (((e.scene IS NOT NULL)::INT + (w.scene IS NOT NULL)::INT) * {px}::DOUBLE) AS gx,
  (CASE WHEN s.scene IS NULL THEN c.v ELSE s.v END - CASE WHEN n.scene IS NULL THEN c.v ELSE n.v END)
    / (((s.scene IS NOT NULL)::INT + (n.scene IS NOT NULL)::INT) * {px}::DOUBLE) AS gy
  FROM {src} c LEFT JOIN {src} e ON e.scene = c.scene AND e.row = c.row AND e.col = c.col + 1
  LEFT JOIN {src} w ON w.scene = c.scene AND w.row = c.row AND w.col = c.col - 1
  LEFT JOIN {src} s ON s.scene = c.scene AND s.row = c.row + 1 AND s.col = c.col
  LEFT JOIN {src} n ON n.scene = c.scene AND n.row = c.row - 1 AND n.col = c.col)"""


@query("f01_finite_differences", fx.with_sql(fx.G1, fx.G2, grad_sql("g2", 2.0)) + f"SELECT scene, row, col, {sql_r(['gx', 'gy'])} FROM gr")
def f01(spark, d):
    out = neighbourhood.differences(fx.g2(fx.g1(spark, d)), 2.0)
    return r6(out.select(*KEY, "gx", "gy"), ["gx", "gy"])


@query("c14_slope", fx.with_sql(fx.G1, fx.G2, grad_sql("g2", 2.0), "k AS (SELECT *, gx + gy IS NOT NULL AS ok, sqrt(gx * gx + gy * gy + 1) AS len FROM gr)") + """
SELECT scene, row, col, round(CASE WHEN ok THEN gx END, 6) + 0.0 AS gx, round(CASE WHEN ok THEN gy END, 6) + 0.0 AS gy,
  round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope_deg,
  round(-gx / len, 6) + 0.0 AS nx, round(1 / len, 6) + 0.0 AS ny, round(-gy / len, 6) + 0.0 AS nz FROM k""")
def c14(spark, d):
    cols = ["gx", "gy", "slope_deg", "nx", "ny", "nz"]
    return r6(surface.slope(fx.g2(fx.g1(spark, d)), 2.0).select(*KEY, *cols), cols)


@query("c15_hillshade", fx.with_sql(fx.G1, fx.G2, "lo AS (SELECT scene, min(v) AS low FROM g2 GROUP BY scene)",
    "sol AS (SELECT scene, row, col, coalesce(v, low) AS v FROM g2 JOIN lo USING (scene))", grad_sql("sol", 10.0)) + """
SELECT scene, row, col, round(least(greatest(sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) +
  cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(315) - atan2(-gx, gy)), 0), 1), 6) + 0.0 AS shade FROM gr""")
def c15(spark, d):
    return r6(surface.hillshade(fx.g2(fx.g1(spark, d)), 10.0).select(*KEY, "shade"), ["shade"])


def blur_sql(src: str, sigma: float, out: str) -> str:
    """Separable reflected blur of ``src(scene,row,col,v)`` as relation ``out``."""
    import math

    rad = math.ceil(4 * sigma)
    norm = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-rad, rad + 1))

    def one(inp, name, pos, other, n):
        p = f"(({pos} + k) % (2 * {n}) + 2 * {n}) % (2 * {n})"
        return f"""{name} AS (SELECT t.scene, t.row, t.col, sum(exp(-k * k / {2 * sigma * sigma}::DOUBLE) / {norm!r}::DOUBLE * s.v) AS v
  FROM (SELECT scene, row, col, k, CASE WHEN {p} < {n} THEN {p} ELSE 2 * {n} - 1 - {p} END AS src
        FROM {inp} JOIN {out}_d USING (scene), range({-rad}, {rad + 1}) kk(k)) t
  JOIN {inp} s ON s.scene = t.scene AND s.{pos} = t.src AND s.{other} = t.{other} GROUP BY 1, 2, 3)"""

    return ",\n".join([
        f"{out}_d AS (SELECT scene, max(row) + 1 AS h, max(col) + 1 AS w FROM {src} GROUP BY scene)",
        one(src, f"{out}_x", "col", "row", "w"), one(f"{out}_x", out, "row", "col", "h"),
    ])


@query("f02_gaussian_blur", fx.with_sql(fx.G1, blur_sql("g1", 2.0, "bl")) + "SELECT scene, row, col, round(v, 6) + 0.0 AS v FROM bl")
def f02(spark, d):
    from altigrid.operators.blur import gaussian

    return r6(gaussian(fx.g1(spark, d), 2.0).select(*KEY, "v"), ["v"])


def area_sql(src: str, h2: str, w2: str, out: str) -> str:
    """Area resize in SQL by exact integer overlaps; ``src`` joins to ``dims(scene,h,w)``."""
    return f"""{out} AS (SELECT scene, CAST(ty AS INTEGER) AS row, CAST(tx AS INTEGER) AS col, sum(o * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN o END), 0) AS v,
    coalesce(sum(CASE WHEN v IS NOT NULL THEN o END), 0) / sum(o) AS frac FROM (
  SELECT scene, v, ty, tx, CAST((least((row + 1) * h2, (ty + 1) * h) - greatest(row * h2, ty * h)) * (least((col + 1) * w2, (tx + 1) * w) - greatest(col * w2, tx * w)) AS DOUBLE) AS o
  FROM (SELECT {src}.*, h, w, {h2} AS h2, {w2} AS w2 FROM {src} JOIN dims USING (scene)) s,
    range(0, 64) a(ty), range(0, 64) b(tx)
  WHERE ty * h < (row + 1) * h2 AND (ty + 1) * h > row * h2 AND tx * w < (col + 1) * w2 AND (tx + 1) * w > col * w2)
  GROUP BY 1, 2, 3)"""


DIMS = "dims AS (SELECT scene, max(row) + 1 AS h, max(col) + 1 AS w FROM g1 GROUP BY scene)"


def bilin_sql(src: str, pts: str, y: str, x: str, out: str, keep: str) -> str:
    """Bilinear lookup of ``src`` at ``pts`` coordinates; light weights never poison."""
    terms, oks = [], []
    for a, (wy, wx) in {"p00": ("1 - ty", "1 - tx"), "p01": ("1 - ty", "tx"), "p10": ("ty", "1 - tx"), "p11": ("ty", "tx")}.items():
        wgt = f"({wy}) * ({wx})"
        terms.append(f"CASE WHEN {wgt} > 1e-10 THEN {wgt} * {a}.v ELSE 0 END")
    joins = " ".join(
        f"LEFT JOIN {src} p{i}{j} ON p{i}{j}.scene = q.scene AND p{i}{j}.row = q.y0 + {i} AND p{i}{j}.col = q.x0 + {j}"
        for i in (0, 1) for j in (0, 1)
    )
    return f"""{out} AS (SELECT {keep}, CASE WHEN p00.scene IS NOT NULL THEN {' + '.join(terms)} END AS value
  FROM (SELECT *, CAST(floor({y}) AS INTEGER) AS y0, CAST(floor({x}) AS INTEGER) AS x0, {y} - floor({y}) AS ty, {x} - floor({x}) AS tx FROM {pts}) q {joins})"""


@query("f02_gaussian_blur_wide", fx.with_sql(fx.G1, DIMS, area_sql("g1", "h // 2", "w // 2", "sm"),
    blur_sql("sm", (9.0**2 - 4 / 12.0) ** 0.5 / 2, "bl"),
    """up AS (SELECT scene, row, col, least(greatest((row + 0.5::DOUBLE) * (h // 2) / h - 0.5::DOUBLE, 0), h // 2 - 1) AS y,
      least(greatest((col + 0.5::DOUBLE) * (w // 2) / w - 0.5::DOUBLE, 0), w // 2 - 1) AS x FROM g1 JOIN dims USING (scene))""",
    bilin_sql("bl", "up", "y", "x", "wide", "q.scene, q.row, q.col")) + "SELECT scene, row, col, round(value, 6) + 0.0 AS v FROM wide")
def f02_wide(spark, d):
    from altigrid.operators.blur import gaussian

    return r6(gaussian(fx.g1(spark, d), 9.0).select(*KEY, "v"), ["v"])


@query("f03_band_split", fx.with_sql(fx.G1, blur_sql("g1", 4.0, "bl")) + """
SELECT scene, row, col, round(bl.v, 6) + 0.0 AS low, round(g1.v - bl.v, 6) + 0.0 AS high FROM g1 JOIN bl USING (scene, row, col)""")
def f03(spark, d):
    from altigrid.operators.blur import band_split

    cells = fx.g1(spark, d)
    return r6(band_split(cells, fx.scenes(cells), 1.0).select(*KEY, "low", "high"), ["low", "high"])


F4_SRC = "gap AS (SELECT scene, row, col, CASE WHEN (row // 7 + col // 9) % 4 <> 1 AND (row * 64 + col) % 17 <> 0 THEN v END AS v, row * 100.0::DOUBLE + col AS other FROM g1)"


@query("f04_nearest_fill", fx.with_sql(fx.G1, F4_SRC, """best AS (SELECT m.scene, m.row, m.col,
    arg_min(struct_pack(v := s.v, o := s.other), (pow(m.row - s.row, 2) + pow(m.col - s.col, 2)) * 1e8 + s.row * 1e4 + s.col) AS b
  FROM gap m JOIN gap s ON s.scene = m.scene WHERE m.v IS NULL AND s.v IS NOT NULL GROUP BY 1, 2, 3)""") + """
SELECT scene, row, col, round(coalesce(v, b.v), 6) + 0.0 AS v, v IS NULL AS filled, coalesce(b.o, other) AS other
FROM gap LEFT JOIN best USING (scene, row, col)""")
def f04(spark, d):
    hole = ((F.floor(F.col("row") / 7) + F.floor(F.col("col") / 9)) % 4 == 1) | ((F.col("row") * 64 + F.col("col")) % 17 == 0)
    gap = fx.g1(spark, d).withColumn("v", F.when(~hole, F.col("v"))).withColumn("other", F.col("row") * 100.0 + F.col("col"))
    out = neighbourhood.fill_nearest(gap, also="other")
    return r6(out.select(*KEY, "v", "filled", "other"), ["v"])


@query("f06_gap_segments", """
WITH s AS (SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN length(text) END AS v FROM (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text FROM conversations GROUP BY 1, 2)),
m AS (SELECT *, v IS NOT NULL AND lag(v) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS st FROM s)
SELECT conv_id, turn, CAST(sum(st::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
FROM m QUALIFY v IS NOT NULL""")
def f06(spark, d):
    c = fx.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    pts = c.select("conv_id", "turn", F.when(F.col("role") != "user", F.length("text")).alias("v"))
    return surface.segments(pts, "conv_id", "turn", "v").select("conv_id", "turn", "segment")


@query("f07_height_cdf", fx.with_sql(fx.G1, fx.G2) + """
SELECT scene, round(v, 9) + 0.0 AS v, n, round((upto - n) / total, 9) + 0.0 AS share_below, round(upto / total, 9) + 0.0 AS share_upto FROM (
  SELECT scene, v, n, CAST(sum(n) OVER (PARTITION BY scene ORDER BY v) AS DOUBLE) AS upto, CAST(sum(n) OVER (PARTITION BY scene) AS DOUBLE) AS total
  FROM (SELECT scene, v, count(*) AS n FROM g2 WHERE v IS NOT NULL GROUP BY 1, 2))""")
def f07(spark, d):
    return r6(surface.height_cdf(fx.g2(fx.g1(spark, d))), ["v", "share_below", "share_upto"], 9)


@query("e22_flooded_share", fx.with_sql(fx.G1, fx.G2, "mm AS (SELECT scene, min(v) AS lo, max(v) AS hi, count(v) AS n FROM g2 GROUP BY scene)",
    "lv AS (SELECT scene, CAST(step AS INTEGER) AS step, lo + pow(step / 500.0::DOUBLE, 2) * (hi - lo) AS level, n FROM mm, range(1, 501) s(step))") + """
SELECT scene, step, round(any_value(level), 6) + 0.0 AS level, round(count(v) / any_value(n), 6) + 0.0 AS share
FROM lv LEFT JOIN g2 ON g2.scene = lv.scene AND g2.v < lv.level GROUP BY ALL""".replace("SELECT scene, step", "SELECT lv.scene, step").replace("GROUP BY ALL", "GROUP BY lv.scene, step"))
def e22(spark, d):
    return r6(surface.flooded_share(fx.g2(fx.g1(spark, d))), ["level", "share"])


@query("d08_point_sampling", fx.with_sql(fx.G1, fx.G2, fx.POINTS, DIMS,
    "every AS (SELECT point, scene, row_f, col_f FROM points UNION ALL SELECT -1 - point, scene, floor(row_f) + 0.5::DOUBLE, floor(col_f) + 0.5::DOUBLE FROM points)",
    "inp AS (SELECT point, scene, row_f - 0.5::DOUBLE AS y, col_f - 0.5::DOUBLE AS x, h, w FROM every JOIN dims USING (scene) WHERE col_f >= 0 AND col_f < w AND row_f >= 0 AND row_f < h)",
    """n4 AS (SELECT point, scene, CAST(floor(y) AS INTEGER) AS y0, CAST(floor(x) AS INTEGER) AS x0, y - floor(y) AS ty, x - floor(x) AS tx,
      CAST(CASE WHEN y = h - 1 THEN greatest(h - 2, 0) ELSE floor(y) + 1 END AS INTEGER) AS y1, CAST(CASE WHEN x = w - 1 THEN greatest(w - 2, 0) ELSE floor(x) + 1 END AS INTEGER) AS x1 FROM inp)""") + """
SELECT point, n4.scene, round((1 - tx) * (1 - ty) * a.v + tx * (1 - ty) * b.v + (1 - tx) * ty * c.v + tx * ty * d.v, 6) + 0.0 AS value FROM n4
LEFT JOIN g2 a ON a.scene = n4.scene AND a.row = y0 AND a.col = x0 LEFT JOIN g2 b ON b.scene = n4.scene AND b.row = y0 AND b.col = x1
LEFT JOIN g2 c ON c.scene = n4.scene AND c.row = y1 AND c.col = x0 LEFT JOIN g2 d ON d.scene = n4.scene AND d.row = y1 AND d.col = x1""")
def d08(spark, d):
    p = fx.points(spark, d)
    centres = p.select((-1 - F.col("point")).alias("point"), "scene", (F.floor("row_f") + 0.5).alias("row_f"), (F.floor("col_f") + 0.5).alias("col_f"), "height")
    out = resample.sample_points(fx.g2(fx.g1(spark, d)), p.unionByName(centres))
    return r6(out.select("point", "scene", "value"), ["value"])


@query("r05_bilinear_sample", fx.with_sql(fx.G1, fx.G2, fx.POINTS, bilin_sql("g2", "points", "row_f", "col_f", "sm", "q.point, q.scene")) + """
SELECT point, scene, round(value, 6) + 0.0 AS height FROM sm""")
def r05(spark, d):
    out = resample.bilinear(fx.g2(fx.g1(spark, d)), fx.points(spark, d).drop("height"))
    return r6(out.select("point", "scene", "height"), ["height"])


def _inspect_ctes(pts: str, key: str) -> list[str]:
    return [
        bilin_sql("g1", pts, "row_f", "col_f", "hh", f"q.{key}, q.scene, q.row_f, q.col_f"),
        f"h3 AS (SELECT hh.{key}, hh.scene, row_f, col_f, value AS height, CASE WHEN value IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gy * gy))) END AS slope FROM hh LEFT JOIN gr ON gr.scene = hh.scene AND gr.row = floor(row_f + 0.5) AND gr.col = floor(col_f + 0.5))",
        bilin_sql("g2", "h3", "row_f", "col_f", "rr", f"q.{key}, q.scene, q.height, q.slope"),
    ]


@query("r06_point_inspect", fx.with_sql(fx.G1, fx.G2, fx.POINTS.replace("value AS height", "value AS h0"), grad_sql("g1"), *_inspect_ctes("points", "point")) + """
SELECT point, scene, round(height, 6) + 0.0 AS height, round(slope, 6) + 0.0 AS slope, round(height - value, 6) + 0.0 AS error FROM rr""")
def r06(spark, d):
    cells = fx.g1(spark, d)
    out = resample.inspect(cells, fx.points(spark, d).drop("height"), fx.g2(cells))
    return r6(out.select("point", "scene", "height", "slope", "error"), ["height", "slope", "error"])


PROFILE = """ln AS (SELECT *, sqrt(pow(c1 - c0, 2) + pow(r1 - r0, 2)) AS cells FROM lines),
pf AS (SELECT scene * 1000000 + line * 10000 + i AS pid, scene, line, CAST(i AS INTEGER) AS i, c0 + (c1 - c0) * (i / (n - 1)::DOUBLE) AS col_f, r0 + (r1 - r0) * (i / (n - 1)::DOUBLE) AS row_f,
  cells * 1.0 * (i / (n - 1)::DOUBLE) AS distance FROM (SELECT *, CAST(least(2048, greatest(2, ceil(cells) + 1)) AS BIGINT) AS n FROM ln) q, range(0, 2048) t(i) WHERE i < n)"""


@query("r07_transect_profile", fx.with_sql(fx.G1, fx.G2, fx.LINES, grad_sql("g1"), PROFILE, *_inspect_ctes("pf", "pid")) + """
SELECT rr.scene, line, i, round(col_f, 6) + 0.0 AS col_f, round(row_f, 6) + 0.0 AS row_f, round(distance, 6) + 0.0 AS distance,
  round(height, 6) + 0.0 AS height, round(slope, 6) + 0.0 AS slope, round(height - value, 6) + 0.0 AS error FROM rr JOIN pf USING (pid)""")
def r07(spark, d):
    cells = fx.g1(spark, d)
    cols = ["col_f", "row_f", "distance", "height", "slope", "error"]
    return r6(resample.profile(cells, fx.lines(cells), 1.0, fx.g2(cells)).select("scene", "line", "i", *cols), cols)


@query("e23_profile_statistics", fx.with_sql(fx.G1, fx.G2, fx.LINES, PROFILE, bilin_sql("g2", "pf", "row_f", "col_f", "hh", "q.scene, q.line, q.i, q.distance")) + """
SELECT scene, line, round(min(value), 6) + 0.0 AS min_h, round(max(value), 6) + 0.0 AS max_h,
  round(arg_max_null(value, i) - arg_min_null(value, i), 6) + 0.0 AS net_change, round(max(distance), 6) + 0.0 AS length FROM hh GROUP BY 1, 2""")
def e23(spark, d):
    cells = fx.g1(spark, d)
    pts = resample.bilinear(fx.g2(cells), resample.profile_points(fx.lines(cells)))
    return r6(resample.profile_stats(pts), ["min_h", "max_h", "net_change", "length"])


@query("b05_profile_sink", fx.with_sql(fx.G1, fx.G2, fx.LINES, grad_sql("g1"), PROFILE, *_inspect_ctes("pf", "pid")) + """
SELECT rr.scene, line, i, round(distance, 6) + 0.0 AS distance_m, round(height, 6) + 0.0 AS height_m, round(col_f, 6) + 0.0 AS "column", round(row_f, 6) + 0.0 AS "row",
  round(slope, 6) + 0.0 AS slope_deg, round(height - value, 6) + 0.0 AS error_m FROM rr JOIN pf USING (pid)""")
def b05(spark, d):
    from altigrid.sources.sinks import profile_columns

    cells = fx.g1(spark, d)
    p = profile_columns(resample.profile(cells, fx.lines(cells), 1.0, fx.g2(cells)), "m", ["scene", "line", "i"])
    return r6(p, ["distance_m", "height_m", "column", "row", "slope_deg", "error_m"])


def _target(cells, h, w, a, off):
    """Target grid per scene over the same ground: size, pixel size and shifted origin."""
    def t(px, x, y):
        return F.struct(F.lit(px).alias("a"), F.lit(0.0).alias("b"), F.lit(x).alias("c"), F.lit(0.0).alias("d"), F.lit(-px).alias("e"), F.lit(y).alias("f"))
    return cells.select("scene").distinct().select("scene", F.lit(h).alias("h"), F.lit(w).alias("w"), t(4.0, 100.0, 900.0).alias("src"), t(a, 100.0 + off, 900.0 - off).alias("dst"))


def _src_pos(a, off, h, w, shift):
    return f"""tg AS (SELECT scene, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, ((r + 0.5::DOUBLE) * {a} + {off}) / 4.0::DOUBLE - {shift}::DOUBLE AS y,
  ((c + 0.5::DOUBLE) * {a} + {off}) / 4.0::DOUBLE - {shift}::DOUBLE AS x FROM (SELECT DISTINCT scene FROM g4), range(0, {h}) rr(r), range(0, {w}) cc(c))"""


@query("r01_resample_bilinear", fx.with_sql(fx.G1, fx.G2_FULL, fx.G4, _src_pos("1.5::DOUBLE", "1.0::DOUBLE", 30, 44, 0.5), bilin_sql("g4", "tg", "y", "x", "rs", "q.scene, q.row, q.col")) + """
SELECT scene, row, col, round(value, 6) + 0.0 AS v FROM rs""")
def r01_bilinear(spark, d):
    coarse = fx.g4(fx.g1(spark, d))
    return r6(resample.resample(coarse, _target(coarse, 30, 44, 1.5, 1.0)), ["v"])


@query("r01_resample_nearest", fx.with_sql(fx.G1, fx.G2_FULL, fx.G4, _src_pos("1.5::DOUBLE", "1.0::DOUBLE", 30, 44, 0.0)) + """
SELECT tg.scene, tg.row, tg.col, round(v, 6) + 0.0 AS v FROM tg LEFT JOIN g4 ON g4.scene = tg.scene AND g4.row = floor(y) AND g4.col = floor(x)""")
def r01_nearest(spark, d):
    coarse = fx.g4(fx.g1(spark, d))
    return r6(resample.resample(coarse, _target(coarse, 30, 44, 1.5, 1.0), "nearest"), ["v"])


_BS = "CASE {i} WHEN 0 THEN pow(1 - {t}, 3) / 6 WHEN 1 THEN (3 * pow({t}, 3) - 6 * {t} * {t} + 4) / 6 WHEN 2 THEN (3 * pow(1 - {t}, 3) - 6 * (1 - {t}) * (1 - {t}) + 4) / 6 ELSE pow({t}, 3) / 6 END"


@query("r01_resample_cubic_spline", fx.with_sql(fx.G1, fx.G2_FULL, fx.G4, _src_pos("1.5::DOUBLE", "1.0::DOUBLE", 30, 44, 0.5),
    f"""tp AS (SELECT tg.*, i, j, {_BS.format(i='i', t='(y - floor(y))')} * {_BS.format(i='j', t='(x - floor(x))')} AS wgt FROM tg, range(0, 4) a(i), range(0, 4) b(j))""") + """
SELECT tp.scene, tp.row, tp.col, round(CASE WHEN count(g4.v) = count(*) THEN sum(wgt * g4.v) END, 6) + 0.0 AS v
FROM (SELECT * FROM tp WHERE wgt > 1e-10) tp LEFT JOIN g4 ON g4.scene = tp.scene AND g4.row = floor(y) - 1 + i AND g4.col = floor(x) - 1 + j GROUP BY 1, 2, 3""")
def r01_cubic(spark, d):
    coarse = fx.g4(fx.g1(spark, d))
    return r6(resample.resample(coarse, _target(coarse, 30, 44, 1.5, 1.0), "cubic_spline"), ["v"])


@query("r03_area_downsample", fx.with_sql(fx.G1, fx.G2, DIMS, area_sql("g2", "greatest(2, round_even(h * (27.0::DOUBLE / greatest(h, w)), 0)::BIGINT)", "greatest(2, round_even(w * (27.0::DOUBLE / greatest(h, w)), 0)::BIGINT)", "ar")) + """
SELECT scene, row, col, round(v, 6) + 0.0 AS v, round(frac, 6) + 0.0 AS valid_frac, v IS NOT NULL AND frac >= 0.5 AS trusted FROM ar""")
def r03(spark, d):
    return r6(resample.area_downsample(fx.g2(fx.g1(spark, d)), 27), ["v", "valid_frac"])


@query("r04_oversize_cap", fx.with_sql(fx.G1, fx.G2, DIMS, area_sql("g2", "greatest(1, round_even(h * least(1.0::DOUBLE, 40.0::DOUBLE / greatest(h, w)), 0)::BIGINT)", "greatest(1, round_even(w * least(1.0::DOUBLE, 40.0::DOUBLE / greatest(h, w)), 0)::BIGINT)", "ar"),
    "od AS (SELECT scene, max(row) + 1 AS h2, max(col) + 1 AS w2 FROM ar GROUP BY scene)") + """
SELECT scene, row, col, round(v, 6) + 0.0 AS v, h2 AS h, w2 AS w, round(0.5::DOUBLE * w / w2, 6) + 0.0 AS a, round(-0.5::DOUBLE * h / h2, 6) + 0.0 AS e, greatest(h, w) > greatest(h2, w2) AS downsampled
FROM ar JOIN od USING (scene) JOIN dims USING (scene)""")
def r04(spark, d):
    from altigrid.queries.scalars import transform_of

    cells = fx.g2(fx.g1(spark, d))
    sc = scene_extent(cells).withColumn("t", transform_of(F.col("scene")))
    out, meta = resample.cap_size(cells, sc, 40)
    j = attach(out, meta.select("scene", "h", "w", F.col("t.a").alias("a"), F.col("t.e").alias("e"), "downsampled"))
    return r6(j.select(*KEY, "v", "h", "w", "a", "e", "downsampled"), ["v", "a", "e"])


@query("r02_reproject_to_utm")
def r02(spark, d):
    cells = fx.g2(fx.g1(spark, d))
    k = F.col("scene")
    # 25 latitudes from 40 south to 80 north: any number of scenes lies on the Earth, in the zones' reach
    west, north = k * 7.0 - 120.0, (k % 25) * 5.0 - 40.0
    t = F.struct(F.lit(0.001).alias("a"), F.lit(0.0).alias("b"), west.alias("c"), F.lit(0.0).alias("d"), F.lit(-0.001).alias("e"), north.alias("f"))
    sc = scene_extent(cells).withColumn("crs", F.lit("EPSG:4326")).withColumn("epsg", F.lit(4326)).withColumn("t", t)
    out, meta = resample.reproject_to_utm(cells, sc)
    j = attach(out, meta.select("scene", "h", "w", "epsg", F.col("t.a").alias("a")))
    return r6(j, ["v", "a"])


MESH_DIMS = """md AS (SELECT scene, h, w, greatest(2, floor((h - 1) * f + 0.5) + 1) AS hr, greatest(2, floor((w - 1) * f + 0.5) + 1) AS wr
  FROM (SELECT *, least(1.0::DOUBLE, 32.0::DOUBLE / (greatest(h, w) - 1)) AS f FROM dims)),
mp AS (SELECT scene * 1000000 + r * 1000 + c AS vid, scene, r, c, h, w, hr, wr, c / (wr - 1) * (w - 1) AS col_f, r / (hr - 1) * (h - 1) AS row_f
  FROM md, range(0, 33) a(r), range(0, 33) b(c) WHERE r < hr AND c < wr)"""


def mesh_tables(spark, d):
    cells = fx.g1(spark, d)
    holed = fx.g2(cells)
    rng = metrics.finite_range(holed, ["scene"]).select("scene", "min_h")
    sc = fx.scenes(cells).join(rng, "scene")
    return resample.mesh(holed, sc, 33, cells)


@query("r08_mesh_vertices", fx.with_sql(fx.G1, fx.G2, DIMS, MESH_DIMS, grad_sql("g2"), bilin_sql("g2", "mp", "row_f", "col_f", "hh", "q.*"), bilin_sql("g1", "mp", "row_f", "col_f", "re", "q.vid"),
    "lo AS (SELECT scene, min(v) AS low FROM g2 GROUP BY scene)",
    """al AS (SELECT hh.scene, hh.r, hh.c, hh.value AS hv, hh.col_f, hh.row_f, hh.h, hh.w, hh.wr, low, re.value AS rv, CASE WHEN gx + gy IS NOT NULL THEN gx ELSE 0 END AS gx2,
      CASE WHEN gx + gy IS NOT NULL THEN gy ELSE 0 END AS gy2, gx + gy IS NOT NULL AS ok FROM hh JOIN re USING (vid) JOIN lo USING (scene)
      LEFT JOIN gr ON gr.scene = hh.scene AND gr.row = floor(hh.row_f + 0.5) AND gr.col = floor(hh.col_f + 0.5))""") + """
SELECT scene, CAST(r * wr + c AS BIGINT) AS vertex, hv IS NOT NULL AS valid, round(col_f - (w - 1) / 2.0::DOUBLE, 6) + 0.0 AS x, round(coalesce(hv, low) - low, 6) + 0.0 AS y, round(row_f - (h - 1) / 2.0::DOUBLE, 6) + 0.0 AS z,
  round(CASE WHEN ok THEN degrees(atan(sqrt(gx2 * gx2 + gy2 * gy2))) ELSE -1 END, 6) + 0.0 AS slope, round(coalesce(hv - rv, 0), 6) + 0.0 AS error, hv - rv IS NOT NULL AS error_valid,
  round(-gx2 / sqrt(gx2 * gx2 + gy2 * gy2 + 1), 6) + 0.0 AS nx, round(1 / sqrt(gx2 * gx2 + gy2 * gy2 + 1), 6) + 0.0 AS ny, round(-gy2 / sqrt(gx2 * gx2 + gy2 * gy2 + 1), 6) + 0.0 AS nz,
  round((col_f + 0.5) / w, 6) + 0.0 AS u, round(1 - (row_f + 0.5) / h, 6) + 0.0 AS t FROM al""")
def r08_vertices(spark, d):
    v, _ = mesh_tables(spark, d)
    cols = ["x", "y", "z", "slope", "error", "nx", "ny", "nz", "u", "t"]
    return r6(v.withColumn("vertex", F.col("vertex").cast("bigint")).select("scene", "vertex", "valid", "error_valid", *cols), cols)


@query("r08_mesh_triangles", fx.with_sql(fx.G1, fx.G2, DIMS, MESH_DIMS, bilin_sql("g2", "mp", "row_f", "col_f", "hh", "q.*"),
    "vv AS (SELECT scene, r, c, CAST(r * wr + c AS BIGINT) AS id FROM hh WHERE value IS NOT NULL)") + """
SELECT a.scene, a.id AS i0, d.id AS i1, b.id AS i2 FROM vv a JOIN vv d ON d.scene = a.scene AND d.r = a.r + 1 AND d.c = a.c JOIN vv b ON b.scene = a.scene AND b.r = a.r AND b.c = a.c + 1
UNION ALL
SELECT b.scene, b.id, d.id, e.id FROM vv b JOIN vv d ON d.scene = b.scene AND d.r = b.r + 1 AND d.c = b.c - 1 JOIN vv e ON e.scene = b.scene AND e.r = b.r + 1 AND e.c = b.c""")
def r08_triangles(spark, d):
    _, t = mesh_tables(spark, d)
    return t.select("scene", *[F.col(f"i{i}").cast("bigint").alias(f"i{i}") for i in range(3)])
