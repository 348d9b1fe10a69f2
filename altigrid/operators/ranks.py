"""Exact grouped ranks and quantiles that never gather a group in one task.

A group that is small is sorted as it is. In a larger one every value belongs to an order-preserving
bucket (its binary exponent and the leading bits of its mantissa). Bucket counts are tiny and combine
before the shuffle; their running sum says which bucket holds a wanted rank and how many values lie below
it. Buckets that are still large are divided again, until what is left to sort is small or a single value.
Nothing is sampled and no value is dropped: the result is the exact order statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col
from altigrid.model import cell_parts, cut_measured, finite

MANTISSA_STEPS = 128.0
EXPONENT_BIAS = 1100
SPLIT = 4096
SORT_ROWS = 250_000  # a larger bucket is divided before it is sorted


def order_code(v: Column) -> Column:
    """Monotone bucket number of a double: never decreases as the value grows.

    A rounding slip of ``log2`` next to a power of two only moves the exponent by one while the
    mantissa leaves [1, 2), which lands in the neighbouring bucket that continues the numbering.
    """
    mag = F.abs(v)
    exp = F.floor(F.log2(mag)).cast("double")
    fine = F.floor((mag / F.pow(F.lit(2.0), exp) - 1.0) * MANTISSA_STEPS)
    code = ((exp + EXPONENT_BIAS) * MANTISSA_STEPS).cast("bigint") + fine.cast("bigint")
    signed = F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, code).otherwise(-code)
    # never NULL for a value: keeps the planner from adding a filter to one of two equal subplans,
    # which would stop it from reusing their shared shuffle
    return F.coalesce(signed, F.lit(0).cast("bigint"))


def _long(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """``by, _m, _v``: finite values of every measure."""
    if len(measures) == 1:
        ((m, c),) = measures.items()
        long = df.select(*by, F.lit(m).alias("_m"), finite(c).alias("_v"))
    else:
        stacked = F.array(*[F.struct(F.lit(m).alias("m"), finite(c).alias("v")) for m, c in measures.items()])
        long = df.select(*by, F.explode(stacked).alias("_s")).select(*by, F.col("_s.m").alias("_m"), F.col("_s.v").alias("_v"))
    return long.where(F.col("_v").isNotNull()).withColumn("_v", F.col("_v") + 0.0)


def _positions(hist: DataFrame, group: list[str], start: Column) -> DataFrame:
    """Adds ``_below``: the rank at which each bucket starts within its group."""
    w = Window.partitionBy(*group).orderBy("_code").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("_below", start + F.sum("_in").over(w) - F.col("_in"))


def value_ranks(df: DataFrame, by: list[str], value) -> DataFrame:
    """``by, v, n, below, total``: each distinct value with its count and the count under it.

    Equal values are one row before anything is sorted; a sort covers one bucket of one group.
    """
    values = _long(df, by, {"v": as_col(value)}).withColumn("_code", order_code(F.col("_v"))).groupBy(*by, "_code", "_v").agg(F.count(F.lit(1)).alias("_n"))
    hist = values.groupBy(*by, "_code").agg(F.sum("_n").alias("_in"))
    offsets = _positions(hist, by, F.lit(0)).withColumn("_total", F.sum("_in").over(Window.partitionBy(*by))).drop("_in")
    inside = Window.partitionBy(*by, "_code").orderBy("_v")
    ahead = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return values.join(offsets, [*by, "_code"]).select(
        *by, F.col("_v").alias("v"), F.col("_n").alias("n"), (F.col("_below") + ahead).alias("below"), F.col("_total").alias("total")
    )


def _inside(start: Column, count: Column) -> Column:
    """Wanted ranks (``_want``) that fall in ``[start, start + count)``."""
    return F.filter("_want", lambda t: (t["rank"] >= start) & (t["rank"] < start + count))


def quantiles(
    df: DataFrame, by: list[str], wanted: dict[str, tuple], lower: bool = False, sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, one column per ``wanted`` entry.

    ``wanted`` maps an output name to ``(value, probability)``. Missing values are skipped; groups
    without any value do not appear. With ``lower`` the value at the rank below is taken as it is.

    A group starts as one bucket, of known count, smallest and largest value. A bucket wider than
    ``sort_rows`` is divided, first into ordered buckets, then between its own smallest and largest value,
    as often as it takes: every division narrows the range, down to a single value, which needs no sort.
    Only what holds a wanted rank goes on; what is left is sorted, a bucket in a task. The divisions run
    when this is called: the buckets to look into are stored, so the pass over the values knows their
    true number (a short list is broadcast by the planner, a long one joined by shuffle).
    """
    measures: dict[str, Column] = {}
    plan = []
    for name, (value, prob) in wanted.items():
        key = value if isinstance(value, str) else next((k for k, c in measures.items() if c is value), f"_x{len(measures)}")
        measures.setdefault(key, as_col(value))
        plan.append((name, key, float(prob)))
    group = [*by, "_m"]
    rows = _long(df, by, measures)

    last = (F.col("_in") - 1).cast("double")
    entries = []
    for name, key, prob in plan:
        pos = last * prob
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            entries.append(F.struct(
                F.lit(key).alias("m"), F.lit(name).alias("q"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"), (pos - F.floor(pos)).alias("frac")))
    counts = [F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    widest = F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_in"))).alias("widest")
    kept = ["_below", "_in", "_lo", "_hi", "_want"]
    whole = rows.groupBy(*group).agg(*counts).withColumn("_below", F.lit(0).cast("bigint"))
    whole = whole.withColumn("_want", F.filter(F.array(*entries), lambda t: t["m"] == F.col("_m")))
    chosen, seen = cut_measured(whole.select(*group, *kept), widest)

    keys, depth = group, 0
    while (seen["widest"] or 0) > sort_rows:
        if depth == 0:
            rows = rows.withColumn("_code", order_code(F.col("_v")))
            parent = chosen.select(*group, F.col("_below").alias("_start"), "_want")
            up = []
        else:
            # the chosen buckets are few; numbering them anew keeps the bucket numbers small at any depth
            slot = F.row_number().over(Window.partitionBy(*group).orderBy("_code"))
            rows = rows.join(chosen.select(*keys, "_lo", "_hi", slot.cast("bigint").alias("_slot")), keys)
            part = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * SPLIT)
            part = F.coalesce(F.least(part, F.lit(SPLIT - 1)), F.lit(0)).cast("bigint")
            rows = rows.select(*group, "_v", F.col("_code").alias("_up"), (F.col("_slot") * SPLIT + part).alias("_code"))
            parent = chosen.select(*group, F.col("_code").alias("_up"), F.col("_below").alias("_start"), "_want")
            up = ["_up"]
        keys = [*group, "_code"]
        hist = rows.groupBy(*group, *up, "_code").agg(*counts).join(parent, [*group, *up])
        hist = _positions(hist, [*group, *up], F.col("_start"))
        hist = hist.withColumn("_want", _inside(F.col("_below"), F.col("_in")))
        chosen, seen = cut_measured(hist.where(F.size("_want") > 0).select(*keys, *kept), widest)
        rows = rows.drop("_up")
        depth += 1

    # a bucket of one value is its own answer
    flat = chosen.where("_lo = _hi").select(*by, F.col("_lo").alias("_v"), F.explode("_want").alias("_t"))
    deal = group if len(measures) > 1 else by  # the name of an only measure is a constant, which the planner drops from the keys
    if depth == 0 and deal:  # all rows are sorted: they are dealt out before the join, into a given number of partitions
        rows = rows.repartition(cell_parts(df.sparkSession), *deal)
    close = rows.join(chosen.where("_lo < _hi").select(*keys, "_below", "_want"), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1 + F.col("_below")
    ranked = close.withColumn("_rank", rank).where(F.array_contains("_want.rank", F.col("_rank").cast("bigint")))
    picked = ranked.select(*by, "_v", F.explode(F.filter("_want", lambda t: t["rank"] == F.col("_rank"))).alias("_t")).union(flat)

    def end(name: str, side: str, field) -> Column:
        return F.max(F.when((F.col("_t.q") == name) & (F.col("_t.side") == side), field))

    out = []
    for name, _, _ in plan:
        lo, hi = end(name, "lo", F.col("_v")), end(name, "hi", F.col("_v"))
        between = lo + (hi - lo) * end(name, "lo", F.col("_t.frac"))
        out.append((lo if lower else between).alias(name))
    return picked.groupBy(*by).agg(*out) if by else picked.agg(*out)
