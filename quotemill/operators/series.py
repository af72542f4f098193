"""Daily price series.

All windows partition by ``code``. ``(code, day)`` is the key of a bar table, so one group
holds at most one row per calendar day; ``daily_bars`` is the way to get there from ticks,
and pre-aggregates on the map side, so a busy code does not travel as raw rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.dates import day as as_day
from quotemill.functions.dates import week_end
from quotemill.functions.values import money_avg, money_sum, pad_change, ratio, round_to
from quotemill.operators.dated import date_between
from quotemill.operators.handed_on import with_previous

TRADING_DAYS_PER_YEAR = 252
MA_PERIODS = (5, 10, 20, 60, 120, 250)


def daily_bars(ticks: DataFrame, code: str, ts: str, price: str,
               size: str | None = None, order: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume and money per code and day from single prints.

    ``order`` is the sequence of prints where ``ts`` alone does not tell it. It should be one
    number or timestamp: fixed-width keys keep the aggregation a hash aggregation, where a
    struct would make Spark sort every print twice.
    """
    sequence = F.col(ts) if order is None else order
    volume = money_sum(size, 2) if size else F.count(F.lit(1)).cast("double")
    return ticks.groupBy(F.col(code).alias("code"), F.to_date(ts).alias("day")).agg(
        F.min_by(price, sequence).alias("open"),
        F.max_by(price, sequence).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        volume.alias("volume"),
        (money_sum(F.col(price) * F.col(size), 2) if size else money_sum(price, 2)).alias("money"),
    )


def by_day() -> Window:
    return Window.partitionBy("code").orderBy("day")


def adjusted(bars: DataFrame, adjust: str = "multiply") -> DataFrame:
    """Adds ``adj_close``: close times factor, or the close itself for pre-adjusted feeds."""
    if adjust == "multiply":
        return bars.withColumn("adj_close", F.col("close") * F.col("factor"))
    if adjust == "none":
        return bars.withColumn("adj_close", F.col("close"))
    raise ValueError(f"adjust must be 'multiply' or 'none', not {adjust!r}")


def daily_returns(bars: DataFrame, start=None, end=None, adjust: str = "multiply",
                  pad: bool = True) -> DataFrame:
    """``code, day, close, adj_close, return``."""
    rows = adjusted(date_between(bars, "day", start, end), adjust)
    return rows.select("code", "day", "close", "adj_close",
                       pad_change(F.col("adj_close"), by_day(), pad).alias("return"))


def _period_returns(bars: DataFrame, label, start, end, adjust: str, pad: bool,
                    next_label, labels_between) -> DataFrame:
    rows = adjusted(date_between(bars, "day", start, end), adjust).withColumn("period_end", label)
    # Rows without a price still open their period, as an empty one.
    last = rows.groupBy("code", "period_end").agg(
        F.max_by("adj_close", F.when(F.col("adj_close").isNotNull(), F.col("day")))
        .alias("adj_close"))
    w = Window.partitionBy("code").orderBy("period_end")
    # Empty periods are laid between a period and its successor; no join to a spine needed.
    spine = last.withColumn("_next", F.lead("period_end").over(w)).withColumn(
        "_label", F.explode(labels_between(F.col("period_end"),
                                           F.coalesce("_next", next_label(F.col("period_end"))))))
    filled = spine.select(
        "code", F.col("_label").alias("day"),
        F.when(F.col("_label") == F.col("period_end"), F.col("adj_close")).alias("adj_close"))
    return filled.select("code", "day", "adj_close",
                         pad_change(F.col("adj_close"), by_day(), pad).alias("return"))


def weekly_returns(bars: DataFrame, start=None, end=None, adjust: str = "multiply",
                   pad: bool = True) -> DataFrame:
    """Last adjusted close of each Sunday-ending week; weeks without bars are present, empty."""
    return _period_returns(
        bars, week_end("day"), start, end, adjust, pad,
        next_label=lambda d: F.date_add(d, 7),
        labels_between=lambda a, b: F.sequence(a, F.date_sub(b, 7), F.expr("interval 7 days")))


def monthly_returns(bars: DataFrame, start=None, end=None, adjust: str = "multiply",
                    pad: bool = True) -> DataFrame:
    """The same by calendar month, labelled with the month's last day."""
    return _period_returns(
        bars, F.last_day("day"), start, end, adjust, pad,
        next_label=lambda d: F.last_day(F.date_add(d, 1)),
        labels_between=lambda a, b: F.transform(
            F.sequence(F.trunc(a, "month"), F.add_months(F.trunc(b, "month"), -1),
                       F.expr("interval 1 month")), F.last_day))


def returns(bars: DataFrame, period: str = "daily", **options) -> DataFrame:
    kinds = {"daily": daily_returns, "weekly": weekly_returns, "monthly": monthly_returns}
    if period not in kinds:
        raise ValueError(f"period must be one of {sorted(kinds)}, not {period!r}")
    return kinds[period](bars, **options)


def volatility(bars: DataFrame, window: int = 20, start=None, end=None,
               adjust: str = "multiply", pad: bool = True) -> DataFrame:
    """Annualised rolling standard deviation of daily returns over ``window`` full values."""
    rets = daily_returns(bars, start, end, adjust, pad)
    frame = by_day().rowsBetween(-(window - 1), 0)
    full = F.count("return").over(frame) >= window
    return rets.select(
        "code", "day", "close", "return",
        F.when(full, F.stddev_samp("return").over(frame) * F.sqrt(F.lit(TRADING_DAYS_PER_YEAR)))
        .alias("volatility"))


def moving_averages(bars: DataFrame, end: dt.date | str,
                    periods: Sequence[int] = MA_PERIODS) -> DataFrame:
    """One row per code: the mean close of its last p bars, NULL with fewer than p.

    Only the newest max(periods) bars of a code take part, so the window is cut down to them
    on both sides of the one shuffle, and the averages are plain conditional sums.
    """
    widest = max(periods)
    recent = date_between(bars, "day", F.date_sub(as_day(end), 2 * widest), end)
    newest = Window.partitionBy("code").orderBy(F.col("day").desc())
    ranked = recent.select("code", "close", F.row_number().over(newest).alias("_n")) \
        .filter(F.col("_n") <= widest)
    averages = []
    for p in periods:
        closes = F.when(F.col("_n") <= p, F.col("close"))
        averages.append(F.when(F.count(closes) == p, round_to(money_avg(closes), 2)).alias(f"ma{p}"))
    return ranked.groupBy("code").agg(*averages).select(
        "code", as_day(end).alias("date"), *[f"ma{p}" for p in periods])


def price_range(bars: DataFrame, as_of: dt.date | str, days: int = 252) -> DataFrame:
    """High, low, last and mean close over a look-back, and where the last close stands."""
    rows = date_between(bars, "day", F.date_sub(as_day(as_of), days), as_of)
    stats = rows.groupBy("code").agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"),
        F.max("high").alias("highest"), F.min("low").alias("lowest"),
        F.max_by("close", "day").alias("latest_close"),
        money_avg("close").alias("avg_price"))
    return stats.select(
        "code", F.lit(days).alias("period_days"), "start_date", "end_date", "highest", "lowest",
        "latest_close", "avg_price",
        (ratio(F.col("latest_close") - F.col("lowest"), F.col("highest") - F.col("lowest"))
         * 100.0).alias("position_pct"))


def latest_rows(df: DataFrame, key: str | Sequence[str] = "code", date_col: str = "day",
                n: int = 1, tie_break: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows per key. Rank limits apply before the shuffle too."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(date_col).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie_break]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def abnormal_moves(bars: DataFrame, as_of: dt.date | str, limit: float = 0.5,
                   days: int | None = 30) -> DataFrame:
    """Day-over-day moves above ``limit`` among the last ``days`` days (all days when None).

    The look-back applies before the previous close is taken, so its first bar has none.
    """
    rows = bars if days is None else date_between(bars, "day", F.date_sub(as_day(as_of), days))
    moved = rows.select("code", "day", "close",
                        F.lag("close").over(by_day()).alias("prev_close"))
    change = F.try_divide(F.abs(F.col("close") - F.col("prev_close")), F.col("prev_close"))
    return (moved.filter(F.col("prev_close") > 0)
            .withColumn("change_ratio", change).filter(F.col("change_ratio") > limit))


def day_changes(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``code, day, close, copies, prev_close, return`` of tables that are not clean.

    For unknown codes (NULL is a code) and any number of rows for a code and day: exact repeats count as
    one row with their number in ``copies``, the others follow each other by day and close (NULLs first).
    Work is dealt by ranges, so no code is too large. On a clean table it gives ``daily_returns`` of closes.
    """
    told_apart = rows.groupBy("code", "day", "close").agg(F.count(F.lit(1)).alias("copies"))
    moved = with_previous(told_apart, ["code"], ["day", "close"], "close", "prev_close", ranges)
    return moved.withColumn("return", ratio("close", "prev_close") - 1.0)


def abnormal_moves_of_dirty_rows(rows: DataFrame, as_of: dt.date | str, limit: float = 0.5,
                                 days: int | None = 30) -> DataFrame:
    """``abnormal_moves`` for tables with unknown codes and repeated days, see ``day_changes``."""
    looked_at = rows if days is None else date_between(rows, "day", F.date_sub(as_day(as_of), days))
    moved = day_changes(looked_at.select("code", "day", "close"))
    return (moved.where("prev_close > 0").withColumn("change_ratio", F.abs("return"))
            .where(F.col("change_ratio") > limit).select("code", "day", "close", "prev_close", "change_ratio"))


def gap_fill_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days between a code's first and last bar on which it has none."""
    from quotemill.operators.calendar import numbered

    cal = F.broadcast(numbered(calendar))
    placed = bars.select("code", "day").join(cal, "day")
    nxt = placed.withColumn("_next", F.lead("idx").over(by_day()))
    holes = nxt.filter(F.col("_next") > F.col("idx") + 1).select(
        "code", F.explode(F.sequence(F.col("idx") + 1, F.col("_next") - 1)).alias("idx"))
    return holes.join(cal, "idx").select("code", "day")
