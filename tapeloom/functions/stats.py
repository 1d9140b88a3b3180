"""Aggregates that stay null, not an error, where they are undefined.

Spark's ``corr`` divides by zero under ANSI mode when a side is constant, even inside a
``when``; these forms give null there. They are plain mergeable aggregates and also work
over a window frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def correlation(x, y, over=None) -> Column:
    """Pearson correlation of the pairs with both sides known."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    parts = [F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))]
    cov, sx, sy = (p.over(over) if over is not None else p for p in parts)
    return cov / F.nullif(sx * sy, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))
