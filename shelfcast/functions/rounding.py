"""Engine-independent rounding.

Spark rounds a double through its exact binary value (``round(0.145D, 2)`` is
0.14 because 0.145 is stored as 0.14499...), pandas rounds half-to-even and
other engines differ again.  Results that must agree to the last digit are
therefore computed in one of two ways:

* money and counts are aggregated exactly (integers or decimals) and an
  average is rounded half-up in the integer domain (``avg_half_up``);
* statistics that are doubles anyway are rounded as ``floor(x * 10^s + 0.5)``
  (``half_up``), a fixed sequence of IEEE operations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def half_up(col, scale: int = 2) -> Column:
    """Round a double half-up at ``scale`` decimals: floor(x*10^s + 0.5) / 10^s."""
    f = float(10 ** scale)
    return (F.floor(_c(col) * F.lit(f) + F.lit(0.5)) / F.lit(f)).cast("double")


def unscaled(col, src_scale: int) -> Column:
    """Exact integer view of a number with ``src_scale`` decimals (cents for money).

    A double goes through DECIMAL first (by its shortest decimal form), so
    0.29 is 29 cents; multiplying the double would give 28.999... and 28.
    """
    return (_c(col).cast(f"decimal(28,{src_scale})") * F.lit(10 ** src_scale)).cast("long")


def int_div(a: Column, b: Column) -> Column:
    """SQL integral division ``a div b`` (exact, truncating)."""
    return F.call_function("div", a, b)


def ratio_half_up(num: Column, den: Column, scale: int = 2, src_scale: int = 0) -> Column:
    """Round num/den half-up where num is a non-negative integer in units of 10^-src_scale.

    Integer arithmetic only, so the result is exact; null when den is 0.
    """
    shift = scale - src_scale
    if shift < 0:
        raise ValueError("scale must be >= src_scale")
    num2 = num.cast("long") * F.lit(2 * 10 ** shift) + den.cast("long")
    q = F.when(den > 0, int_div(num2, den.cast("long") * F.lit(2)))
    return (q / F.lit(float(10 ** scale))).cast("double")


def avg_half_up(col, scale: int = 2, src_scale: int = 0) -> Column:
    """Aggregate: exact average of a non-negative integer/decimal column, rounded half-up.

    ``src_scale`` is the number of decimals the column carries (0 for unit
    counts, 2 for money).  Nulls are ignored, as in ``avg``.
    """
    c = _c(col)
    num = F.sum(unscaled(c, src_scale)) if src_scale else F.sum(c.cast("long"))
    return ratio_half_up(num, F.count(c), scale, src_scale)


def sum_money(col) -> Column:
    """Aggregate: exact sum of a decimal money column, returned as a double."""
    return F.sum(_c(col)).cast("double")
