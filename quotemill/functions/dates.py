"""Date expressions: lenient parsing, report quarters, load windows, cutoffs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: history starts here unless a caller says otherwise.
HISTORY_START = dt.date(2019, 1, 1)
DAILY_BASIC_START = dt.date(2018, 1, 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(d: dt.date | str | Column) -> Column:
    """A date literal from a date or ISO text; columns pass through."""
    if isinstance(d, Column):
        return d
    return F.lit(d).cast("date")


def parse_date(c: Column | str) -> Column:
    """``yyyy-MM-dd``, ``yyyy/MM/dd`` or ``yyyyMMdd`` text to DATE; anything else NULL.

    The shape is tested before parsing, so ``20240101`` is never read as a year.
    """
    s = F.trim(_col(c).cast("string"))
    return (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(s, "yyyy/M/d"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
    )


def compact_date(c: Column | str) -> Column:
    """DATE to ``yyyyMMdd`` text."""
    return F.date_format(_col(c), "yyyyMMdd")


def from_compact(c: Column | str) -> Column:
    return F.try_to_date(_col(c).cast("string"), "yyyyMMdd")


def trade_timestamp(trade_date: Column | str, time_text: Column | str) -> Column:
    """Date plus ``HH:MM:SS``; missing or malformed time means midnight."""
    d, t = _col(trade_date), _col(time_text)
    stamp = F.when(
        t.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$"),
        F.try_to_timestamp(F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), t),
                           F.lit("yyyy-MM-dd H:m:s")),
    )
    return F.coalesce(stamp, d.cast("timestamp")).cast("timestamp_ntz")


def due_report_quarter(c: Column | str) -> Column:
    """Quarter end whose report is due on a date (fixed values: month limits 3, 4, 8, 10)."""
    d = _col(c)
    y, m = F.year(d), F.month(d)

    def quarter_end(year: Column, month: int, dom: int) -> Column:
        return F.make_date(year, F.lit(month), F.lit(dom))

    return (
        F.when(m <= 3, quarter_end(y - 1, 12, 31))
        .when(m <= 4, quarter_end(y, 3, 31))
        .when(m <= 8, quarter_end(y, 6, 30))
        .when(m <= 10, quarter_end(y, 9, 30))
        .otherwise(quarter_end(y, 12, 31))
    )


def is_quarter_end(c: Column | str) -> Column:
    return F.date_format(_col(c), "MM-dd").isin("03-31", "06-30", "09-30", "12-31")


def quarter_start(c: Column | str) -> Column:
    return F.date_trunc("quarter", _col(c)).cast("date")


def week_end(c: Column | str) -> Column:
    """The Sunday that closes a date's week (a Sunday closes its own)."""
    return F.date_add(F.date_trunc("week", _col(c)).cast("date"), 6)


def drop_far_future(c: Column | str) -> Column:
    """Feeds write 'never' as a date after 2100; here it is NULL."""
    d = _col(c)
    return F.when(F.year(d) <= 2100, d)


def window_start(list_date: Column | str, floor: dt.date = HISTORY_START) -> Column:
    return F.greatest(F.coalesce(_col(list_date), F.lit(floor)), F.lit(floor))


def window_end(given: Column | None, delist: Column | str, as_of: dt.date | str) -> Column:
    """Given end, else delisting date, never after ``as_of``."""
    end = drop_far_future(_col(delist))
    if given is not None:
        end = F.coalesce(given, end)
    return F.least(F.coalesce(end, day(as_of)), day(as_of))


def last_closed_day(ts: Column | str, closing_hour: int = 15) -> Column:
    """The date itself once the market closed, the day before until then."""
    t = _col(ts)
    return F.when(F.hour(t) >= closing_hour, F.to_date(t)).otherwise(
        F.date_sub(F.to_date(t), 1))
