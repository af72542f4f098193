"""Trading calendar taken from the price table itself.

Calendar frames hold at most one row per date. The DATE domain bounds them (a century is
36,525 rows), whatever the size of the price table, so they may be broadcast and ordered
in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.dates import day as as_day
from quotemill.operators.dated import date_between


def trading_calendar(prices: DataFrame, start: dt.date | str | None = None,
                     end: dt.date | str | None = None, col: str = "day") -> DataFrame:
    """Distinct trading days, one column ``day`` of type DATE, whatever the type of ``col``."""
    rows = date_between(prices, col, start, end)
    return rows.select(F.col(col).cast("date").alias("day")).filter(F.col("day").isNotNull()).distinct()


def numbered(calendar: DataFrame) -> DataFrame:
    """``day, idx`` with idx = 1 for the first trading day."""
    return calendar.select("day", F.row_number().over(Window.orderBy("day")).alias("idx"))


def dense_index(calendar: DataFrame) -> DataFrame:
    """Every date from the first to the last trading day with the count of trading days so far.

    Turns "trading days between two dates" into two equality lookups.
    """
    span = calendar.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL")
    dates = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    marked = dates.join(calendar, F.col("date") == F.col("day"), "left")
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("date", F.col("day").isNotNull().alias("is_open"),
                         F.count("day").over(upto).alias("idx"))


def trading_days_between(df: DataFrame, calendar: DataFrame, start: str, end: str,
                         out: str = "expected_days") -> DataFrame:
    """Adds the number of trading days in ``[start, end]`` (0 when start is after end)."""
    dense = dense_index(calendar)
    lo = dense.select(F.col("date").alias("_lo"), F.col("idx").alias("_i_lo"),
                      F.col("is_open").cast("int").alias("_open_lo"))
    hi = dense.select(F.col("date").alias("_hi"), F.col("idx").alias("_i_hi"))
    # Dates outside the calendar are clamped onto it, so every lookup finds its row.
    clamped = df.select(
        *df.columns, F.greatest(F.col(start), calendar.agg(F.min("day")).scalar()).alias("_a"),
        F.least(F.col(end), calendar.agg(F.max("day")).scalar()).alias("_b"))
    return (
        clamped.join(F.broadcast(lo), F.col("_a") == F.col("_lo"), "left")
        .join(F.broadcast(hi), F.col("_b") == F.col("_hi"), "left")
        .select(*df.columns,
                F.when(F.col("_a") <= F.col("_b"),
                       F.col("_i_hi") - F.col("_i_lo") + F.col("_open_lo"))
                .otherwise(F.lit(0)).cast("bigint").alias(out))
    )


def last_trading_day(dates: DataFrame, calendar: DataFrame, col: str = "date",
                     n: int = 0, out: str = "trading_day") -> DataFrame:
    """The n-th trading day counted back from each date.

    ``n = 0`` is the date itself when open, else the last open day before it. Dates after
    the calendar's end count from its last day. NULL when the calendar is too short.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    dense = dense_index(calendar).select(F.col("date").alias("_d"), F.col("idx").alias("_i"))
    days = numbered(calendar).select(F.col("day").alias(out), F.col("idx").alias("_j"))
    return (
        dates.withColumn("_look", F.least(F.col(col), calendar.agg(F.max("day")).scalar()))
        .join(F.broadcast(dense), F.col("_look") == F.col("_d"), "left")
        .join(F.broadcast(days), F.col("_i") - F.lit(n) == F.col("_j"), "left")
        .select(*dates.columns, out)
    )


def previous_trading_days(calendar: DataFrame, n: int) -> DataFrame:
    """For every trading day the one ``n`` days before it."""
    return calendar.select("day", F.lag("day", n).over(Window.orderBy("day")).alias("previous_day"))


def off_calendar(df: DataFrame, calendar: DataFrame, col: str,
                 start: dt.date | str | None = None) -> DataFrame:
    """Rows dated on a day without trading."""
    rows = df if start is None else df.filter(F.col(col) >= as_day(start))
    days = F.broadcast(calendar.select(F.col("day").alias("_open")))
    return rows.join(days, F.col(col) == F.col("_open"), "left_anti")


def on_calendar(df: DataFrame, calendar: DataFrame, col: str) -> DataFrame:
    """Rows dated on a trading day; rows without a date are dropped."""
    days = F.broadcast(calendar.select(F.col("day").alias("_open")))
    return df.join(days, F.col(col) == F.col("_open"), "left_semi")


def missing_snapshot_days(snapshots: DataFrame, calendar: DataFrame, col: str,
                          start: dt.date | str) -> DataFrame:
    """Trading days from ``start`` to the newest snapshot on which nobody has a snapshot."""
    seen = snapshots.select(F.col(col).alias("day")).filter(F.col("day") >= as_day(start)).distinct()
    last = snapshots.agg(F.max(col)).scalar()
    within = calendar.filter((F.col("day") >= as_day(start)) & (F.col("day") <= last))
    return within.select("day").join(seen, "day", "left_anti")
