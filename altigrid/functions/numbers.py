"""Rounding, clipping and guarded statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo, hi) -> Column:
    """Clip and keep NULL (``greatest``/``least`` would drop it)."""
    c = as_col(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def half_up(c) -> Column:
    return F.floor(as_col(c) + 0.5)


def pearson(x, y) -> Column:
    """Grouped correlation that is 0 when either side is constant.

    The built-in ``corr`` raises a division error on a constant group in ANSI mode.
    """
    x, y = as_col(x), as_col(y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))


def rounded(c, digits: int = 6) -> Column:
    """Round for output; adding 0 turns -0.0 into 0.0."""
    return F.round(as_col(c), digits) + F.lit(0.0)
