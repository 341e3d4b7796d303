"""Aggregate expressions with the sample conventions of the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r that cannot raise under ANSI mode.

    ``regr_*`` aggregates only see rows where both values are present. A pair
    where either side is constant over the complete rows gives NULL.
    """
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    r = F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
    return (F.when((F.min(xs) == F.max(xs)) | (F.min(ys) == F.max(ys)),
                   F.lit(None).cast("double"))
            .otherwise(r))
