"""What may be wrong with figures, each said once: used by rules, checks and row validity.

A missing figure never makes a condition true; where it must not be missing, ``present`` says so.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(*columns: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def below_zero(*columns: str) -> Column:
    """Any of the figures is negative."""
    return (F.least(*columns) if len(columns) > 1 else F.col(columns[0])) < 0


def not_positive(*columns: str) -> Column:
    """Any of the figures is zero or less."""
    return (F.least(*columns) if len(columns) > 1 else F.col(columns[0])) <= 0


def outside(column: str, low: float, high: float) -> Column:
    return ~F.col(column).between(F.lit(low), F.lit(high))


def leaves_band(low: str, high: str, centre: str, share: float) -> Column:
    """The range runs further from its centre than a share of it, upwards or downwards."""
    return (F.col(high) > F.col(centre) * (1 + share)) | (F.col(low) < F.col(centre) * (1 - share))


def not_bracketed(low: str, high: str, *inner: str) -> Column:
    """One of the inner figures lies outside of the range."""
    return (F.col(high) < F.greatest(*inner)) | (F.col(low) > F.least(*inner))


def gap(whole: str, *parts: str) -> Column:
    """How far a whole is from the sum of its parts."""
    return F.abs(F.col(whole) - reduce(add, [F.col(p) for p in parts]))


def gap_share(whole: str, *parts: str) -> Column:
    """The gap as a share of the whole; NULL for a whole of zero."""
    return F.try_divide(gap(whole, *parts), F.abs(F.col(whole)))


def misstated_product(stated: str, a: str, b: str, tolerance: float) -> Column:
    """The stated figure is not a times b, where all three are positive."""
    error = F.try_divide(F.abs(F.col(a) * F.col(b) - F.col(stated)), F.col(stated))
    return (F.least(a, b, stated) > 0) & present(a, b, stated) & (error > tolerance)


# --- the same for whole rows -------------------------------------------------

PRICES = ("open", "high", "low", "close")
HOLDING = ("position_quantity", "available_quantity", "frozen_quantity")
CASH = ("position_market_value", "available_cash", "frozen_cash")


def bar_clash() -> Column:
    """A bar that cannot be: its high under its low, or a negative figure."""
    return (F.col("high") < F.col("low")) | below_zero(*PRICES, "volume")


def holding_clash() -> Column:
    """More shares free or frozen than held, or a negative number of them."""
    held, free, frozen = (F.col(c) for c in HOLDING)
    return below_zero(*HOLDING[:2]) | (F.greatest(frozen, free + frozen) > held)


def account_clash(tolerance: float = 10) -> Column:
    """An account with assets whose parts do not add up to them."""
    return (F.col("total_assets") > 0) & (gap("total_assets", *CASH) > tolerance)
