"""Date ranges that also skip the folders of tables stored by year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.dates import day as as_day
from quotemill.schemas import PARTITION_YEAR, WATERMARK

# Date columns by whose year stored tables are split. pub_date is not one of them.
_FOLDER_DATES = set(WATERMARK.values())


def date_between(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Inclusive date range. Tables stored by year are cut to those years' folders as well."""
    by_year = PARTITION_YEAR in df.columns and col in _FOLDER_DATES
    if start is not None:
        df = df.filter(F.col(col) >= as_day(start))
        df = df.filter(F.col(PARTITION_YEAR) >= F.year(as_day(start))) if by_year else df
    if end is not None:
        df = df.filter(F.col(col) <= as_day(end))
        df = df.filter(F.col(PARTITION_YEAR) <= F.year(as_day(end))) if by_year else df
    return df


def dates_in(df: DataFrame, col: str, dates: Sequence[dt.date | str | Column]) -> DataFrame:
    """Rows on any of the dates. Tables stored by year are cut to those years' folders as well."""
    wanted = [as_day(d) for d in dates]
    if PARTITION_YEAR in df.columns and col in _FOLDER_DATES:
        df = df.filter(F.col(PARTITION_YEAR).isin([F.year(d) for d in wanted]))
    return df.filter(F.col(col).isin(wanted))
