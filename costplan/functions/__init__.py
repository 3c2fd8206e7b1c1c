"""Column functions that several modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def geometric_mean(x: Column) -> Column:
    """Over the positive values; null if there are none."""
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def family_of(n: Column) -> Column:
    """Size class of a query of n relations."""
    return F.when(n <= 4, "small").when(n <= 7, "medium").otherwise("large")


def zipf_index(u: Column, n: int, s: float) -> Column:
    """An index in [0, n) from a uniform u: uniform for s <= 0, else the inverse of a continuous power law."""
    if s <= 0:
        x = u * n
    elif s == 1:
        x = F.exp(u * F.log(F.lit(float(n) + 1))) - 1
    else:
        x = F.pow(u * F.lit((n + 1) ** (1 - s) - 1) + 1, F.lit(1 / (1 - s))) - 1
    return F.least(F.floor(x), F.lit(n - 1)).cast("long")
