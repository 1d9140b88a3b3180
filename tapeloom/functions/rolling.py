"""Rolling operators per instrument, as functions from column to column.

Rules, fixed here because the studied scripts only call such operators:

* a window of ``d`` means the row and the ``d - 1`` rows before it, of the same
  instrument, by day; at the start the rows there are, are used;
* ``std``, ``corr``, ``slope``, ``rsquare``, ``resi`` are null with fewer than two values;
* ``std`` is the sample deviation, ``quantile`` interpolates linearly;
* ``rank`` is (values below + (values equal + 1) / 2) / values, in (0, 1];
* ``idx_max`` / ``idx_min`` count places from 1 at the window start, earliest on ties;
* a comparison with a missing side is false.

All operators share ``partitionBy(inst).orderBy(dt)``: one exchange and one sort for any
number of features. An instrument has at most one row per trade day, so its partition
has a fixed size bound whatever the volume of raw bars. Window expressions do not nest
in Spark: name the inner one with ``withColumn`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import correlation

KEYS = ["inst"]
ORDER = ["dt"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def own():
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def last_rows(d: int):
    return own().rowsBetween(-(d - 1), 0)


def position() -> Column:
    """Row number inside the instrument; ``slope`` and ``idx_max`` take it as ``t``."""
    return F.row_number().over(own()).cast("double")


def ref(x, d: int) -> Column:
    return F.lag(_c(x), d).over(own())


def ahead(x, d: int) -> Column:
    return F.lead(_c(x), d).over(own())


def mean(x, d: int) -> Column:
    return F.avg(_c(x)).over(last_rows(d))


def std(x, d: int) -> Column:
    return F.stddev_samp(_c(x)).over(last_rows(d))


def total(x, d: int) -> Column:
    return F.sum(_c(x)).over(last_rows(d))


def highest(x, d: int) -> Column:
    return F.max(_c(x)).over(last_rows(d))


def lowest(x, d: int) -> Column:
    return F.min(_c(x)).over(last_rows(d))


def quantile(x, d: int, q: float) -> Column:
    return F.percentile(_c(x), F.lit(q)).over(last_rows(d))


def rank(x, d: int) -> Column:
    """The window's values are gathered per row: at most ``d`` of them."""
    x = _c(x)
    seen = F.collect_list(x).over(last_rows(d))
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (equal + 1) / 2.0) / F.nullif(F.size(seen), F.lit(0)))


def _place(x: Column, d: int, t: Column) -> Column:
    w = last_rows(d)
    at = F.max_by(t, F.when(x.isNotNull(), F.struct(x, -t))).over(w)
    return at - t + F.count(F.lit(1)).over(w)


def idx_max(x, d: int, t="t") -> Column:
    return _place(_c(x), d, _c(t))


def idx_min(x, d: int, t="t") -> Column:
    return _place(-_c(x), d, _c(t))


def _pairs(x: Column, t: Column, d: int) -> Column:
    return F.count(F.when(x.isNotNull() & t.isNotNull(), 1)).over(last_rows(d))


def slope(x, d: int, t="t") -> Column:
    x, t = _c(x), _c(t)
    return F.when(_pairs(x, t, d) >= 2, F.regr_slope(x, t).over(last_rows(d)))


def rsquare(x, d: int, t="t") -> Column:
    x, t = _c(x), _c(t)
    return F.when(_pairs(x, t, d) >= 2, F.regr_r2(x, t).over(last_rows(d)))


def resi(x, d: int, t="t") -> Column:
    x, t = _c(x), _c(t)
    w = last_rows(d)
    fit = F.regr_slope(x, t).over(w) * t + F.regr_intercept(x, t).over(w)
    return F.when(_pairs(x, t, d) >= 2, x - fit)


def corr(x, y, d: int) -> Column:
    """Null with fewer than two pairs, and null where either side does not move."""
    return correlation(x, y, last_rows(d))


def greater(a, b) -> Column:
    """Elementwise maximum; null when either side is."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def less(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def is_true(cond: Column) -> Column:
    """1 / 0, with an unknown comparison as 0."""
    return F.when(cond, 1.0).otherwise(0.0)


def log1(x) -> Column:
    return F.ln(_c(x) + 1)


def full_window(value: Column, d: int) -> Column:
    """Null until the instrument has ``d`` rows."""
    return F.when(F.count(F.lit(1)).over(last_rows(d)) >= d, value)
