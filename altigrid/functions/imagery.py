"""Band handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altigrid.functions.numbers import as_col


def select_bands(bands, rgb_bands: tuple[int, ...] = (1, 2, 3)) -> Column:
    """struct<r,g,b> from a band array. One or two bands are grey; otherwise too few is an
    error."""
    bands = as_col(bands)
    n = F.size(bands)
    grey = F.struct(*[F.element_at(bands, 1).alias(c) for c in "rgb"])
    # try_element_at: both branches may be evaluated before the choice is made
    colour = F.struct(*[F.try_element_at(bands, F.lit(i)).alias(c) for c, i in zip("rgb", rgb_bands)])
    wrong = F.raise_error(F.concat(F.lit("Image has "), n.cast("string"), F.lit(" bands; the RGB bands don't fit.")))
    return (
        F.when(n >= max(rgb_bands), colour).when(n.isin(1, 2), grey).otherwise(F.when(wrong.isNull(), grey))
    )
