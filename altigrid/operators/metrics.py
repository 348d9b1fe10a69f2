"""Accuracy metrics over prediction/reference pairs.

Grouping is free: a tile, a scene, a landscape or the whole table. Everything but the medians is a
combinable aggregate; the medians come from :mod:`altigrid.operators.ranks`, which splits hot
groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.functions.numbers import pearson
from altigrid.model import attach, cut, finite
from altigrid.operators.joins import valid_pairs
from altigrid.operators.ranks import quantiles

NMAD_K = 1.4826  # fixed value: makes NMAD equal the standard deviation of normal errors
FLOOR = 1e-6
METRICS = ["rmse", "mae", "pearson_r", "bias", "nmad", "offset_free_rmse"]


def _errors(df: DataFrame, pred: str, ref: str, by: list[str], mask: Column | None) -> DataFrame:
    """All rows; the three values are NULL unless both sides are finite and the mask holds."""
    p, r = finite(pred), finite(ref)
    keep = p.isNotNull() & r.isNotNull()
    if mask is not None:
        keep = keep & F.coalesce(mask, F.lit(False))
    pick = [F.when(keep, c).alias(n) for n, c in (("_p", p), ("_r", r), ("_e", p - r))]
    return df.select(*by, *pick)


def median_and_mad(e: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Median (``_med``) and median distance from it (``_mad``) of a stored table's column."""
    med = cut(quantiles(e, by, {"_med": (value, 0.5)}))
    dev = attach(e.where(F.col(value).isNotNull()).select(*by, value), med, by).select(*by, F.abs(F.col(value) - F.col("_med")).alias("_d"))
    return med, quantiles(dev, by, {"_mad": ("_d", 0.5)})


def dsm_metrics(
    df: DataFrame, pred: str, ref: str, by: list[str], mask: Column | None = None
) -> DataFrame:
    """Rmse, mae, pearson_r, bias, nmad, offset_free_rmse, n_pixels per group.

    Every group of the input has a row; with fewer than two valid pairs it keeps only ``n_pixels``.
    The offset-free RMSE follows from the variance and the distance of mean and median, so it needs
    no pass of its own. Runs the histograms of the medians when called (see ``quantiles``).
    """
    if not by:
        return dsm_metrics(df.withColumn("_all", F.lit(1)), pred, ref, ["_all"], mask).drop("_all")
    # read by three passes; the joins behind it run once
    e = cut(_errors(df, pred, ref, by, mask))
    sums = e.groupBy(*by).agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"),
        pearson("_p", "_r").alias("pearson_r"),
        F.avg("_e").alias("bias"),
        F.var_pop("_e").alias("_var"),
        F.count("_e").alias("n_pixels"),
    )
    med, mad = median_and_mad(e, "_e", by)
    out = sums.join(med, by, "left").join(mad, by, "left")
    free = F.sqrt(F.col("_var") + F.pow(F.col("bias") - F.col("_med"), 2))
    cols = {
        "rmse": F.col("rmse"), "mae": F.col("mae"), "pearson_r": F.col("pearson_r"), "bias": F.col("bias"),
        "nmad": NMAD_K * F.col("_mad"), "offset_free_rmse": free,
    }
    enough = F.col("n_pixels") >= 2
    return out.select(*by, *[F.when(enough, c).alias(n) for n, c in cols.items()], "n_pixels")


def compare(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """Rmse, mae, bias, count and largest absolute error in one pass.

    A group without a single valid pair yields NULL metrics and count 0.
    """
    p, r = finite(pred), finite(ref)
    e = p - r  # NULL unless both are finite
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.count(e).alias("count"),
        F.max(F.abs(e)).alias("max_abs"),
    )


def finite_range(cells: DataFrame, by: list[str]) -> DataFrame:
    """Min, max and count of the finite cells; ``error`` is set where there is none."""
    v = finite("v")
    out = cells.groupBy(*by).agg(F.min(v).alias("min_h"), F.max(v).alias("max_h"), F.count(v).alias("count"))
    return out.withColumn("error", F.when(F.col("count") == 0, "no finite elevations"))


def replace_declared_range(meta: DataFrame, measured: DataFrame, on: str = "scene") -> DataFrame:
    """The measured range takes the place of the declared one in metadata rows."""
    m = measured.select(on, F.col("min_h").alias("_lo"), F.col("max_h").alias("_hi"))
    return (
        meta.join(m, on, "left")
        .withColumn("min_h", F.coalesce("_lo", "min_h"))
        .withColumn("max_h", F.coalesce("_hi", "max_h"))
        .drop("_lo", "_hi")
    )


def affine_fit(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """Least-squares ``ref = align_a * pred + align_b`` per group."""
    e = valid_pairs(df, pred, ref)
    return e.groupBy(*by).agg(
        F.regr_slope(ref, pred).alias("align_a"), F.regr_intercept(ref, pred).alias("align_b")
    )


def relative_metrics(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """E1 after the best least-squares scale and shift of the prediction.

    Every group of the input has a row, as in E1; without a valid pair it keeps only ``n_pixels``.
    """
    pairs = cut(df.select(*by, pred, ref))
    fit = cut(affine_fit(pairs, pred, ref, by))
    aligned = attach(pairs, fit, by, "left").withColumn(
        "_aligned", F.col("align_a") * F.col(pred) + F.col("align_b")
    )
    return dsm_metrics(aligned, "_aligned", ref, by).join(fit, by, "left")


def polarity(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """E5: correlation per tile; positive means taller surfaces got larger values.

    A tile with fewer than two valid pairs has a NULL ``r``; the verdict counts tiles that have one.
    """
    e = _errors(df, pred, ref, by, None)
    return e.groupBy(*by).agg(F.when(F.count("_e") >= 2, pearson("_p", "_r")).alias("r"))


def polarity_verdict(per_tile: DataFrame) -> DataFrame:
    """Fleet verdict: flipped when the mean is not positive or most tiles are negative."""
    agg = per_tile.agg(
        F.count("r").alias("tiles"), F.avg("r").alias("mean_r"), F.count_if(F.col("r") < 0).alias("negative")
    )
    flipped = (F.col("mean_r") <= 0) | (F.col("negative") > F.col("tiles") / 2)
    return agg.withColumn(
        "verdict", F.when(flipped, "flipped").when(F.col("negative") > 0, "warning").otherwise("ok")
    )


def coverage(cells: DataFrame, by: list[str]) -> DataFrame:
    """Share of finite cells."""
    return cells.groupBy(*by).agg(F.avg(finite("v").isNotNull().cast("double")).alias("coverage"))


def datum_check(three: DataFrame, by: list[str]) -> DataFrame:
    """Does model ``a`` minus model ``b`` look like the geoid ``n``? Input: D13 rows."""
    x = three.select(
        *by, "a", "b", "n", (F.col("a") - F.col("b")).alias("_d"), (F.col("a") - F.col("n") - F.col("b")).alias("_left")
    )
    x = cut(x)
    sums = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), pearson("a", "b").alias("pearson_r"),
        F.min("n").alias("geoid_min"), F.max("n").alias("geoid_max"),
    )
    med, mad = median_and_mad(x, "_d", by)
    rest = quantiles(x, by, {"geoid_median": ("n", 0.5), "corrected_median": ("_left", 0.5)})
    out = sums.join(med.withColumnRenamed("_med", "diff_median"), by).join(rest, by).join(mad, by)
    return out.withColumn("diff_nmad", NMAD_K * F.col("_mad")).drop("_mad")


def ssi_l1(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """Mean absolute difference after each side lost its median and mean absolute deviation.

    For an even count the *lower* of the two middle values is the median, as in the reference
    normalisation.
    """
    e = cut(_errors(df, pred, ref, by, None).where("_e is not null"))
    med = cut(lower_medians(e, by, {"_mp": "_p", "_mr": "_r"}))
    centred = attach(e, med, by).select(
        *by, (F.col("_p") - F.col("_mp")).alias("_cp"), (F.col("_r") - F.col("_mr")).alias("_cr")
    )
    scale = centred.groupBy(*by).agg(
        F.greatest(F.avg(F.abs("_cp")), F.lit(FLOOR)).alias("_sp"),
        F.greatest(F.avg(F.abs("_cr")), F.lit(FLOOR)).alias("_sr"),
    )
    diff = F.abs(F.col("_cp") / F.col("_sp") - F.col("_cr") / F.col("_sr"))
    return attach(centred, scale, by).groupBy(*by).agg(F.avg(diff).alias("ssi_l1"))


def lower_medians(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    """Median as an element of the data: the lower middle one for an even count."""
    return quantiles(df, by, {name: (c, 0.5) for name, c in cols.items()}, lower=True)
