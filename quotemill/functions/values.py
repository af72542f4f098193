"""Numeric helpers that keep sums independent of row order, and null handling."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: Column | str, scale: int = 4) -> Column:
    """Sum as DECIMAL, returned as DOUBLE: the same whatever the partitioning.

    Addends keep ten decimals and amounts up to 10^28; only the sum is rounded to ``scale`` decimals.
    """
    return F.sum(_col(c).cast("decimal(38,10)")).cast(f"decimal(38,{scale})").cast("double")


def money_avg(c: Column | str, scale: int = 4) -> Column:
    x = _col(c)
    return F.try_divide(money_sum(x, scale), F.count(x).cast("double"))


def sum_when(cond: Column, c: Column | str, scale: int = 4) -> Column:
    """Sum over rows that meet ``cond``; the others add zero."""
    return money_sum(F.when(cond, _col(c)).otherwise(F.lit(0.0)), scale)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(_col(a), _col(b))


def round_to(c: Column | str, digits: int) -> Column:
    """Rounds the binary value: scaled, rounded to whole, scaled back.

    ``F.round`` rounds the printed decimal instead, so 35.925 (stored just below) would go up.
    """
    return F.round(_col(c) * F.lit(float(10 ** digits))) / F.lit(float(10 ** digits))


def relative_error(actual: Column, stated: Column) -> Column:
    return F.try_divide(F.abs(actual - stated), stated)


def blank_to_null(c: Column | str, dtype: T.DataType) -> Column:
    """Empty text and NaN become NULL."""
    x = _col(c)
    if isinstance(dtype, T.StringType):
        return F.nullif(x, F.lit(""))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x), x)
    return x


def to_number(c: Column | str) -> Column:
    """Text to DOUBLE; what is not a number becomes NULL."""
    return _col(c).try_cast("double")


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def pad_change(series: Column, window, pad: bool = True) -> Column:
    """Change against the previous row.

    ``pad`` carries the last known value over NULLs first, so a gap reads as no change.
    """
    if pad:
        filled = F.last(series, ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.last(series, ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, -1))
        return F.try_divide(filled, before) - 1.0
    return F.try_divide(series, F.lag(series).over(window)) - 1.0
