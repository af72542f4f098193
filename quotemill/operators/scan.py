"""Reads of the market and account tables: ranges, batches, filters, pages, rankings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.codes import in_exchange_scope, is_active, is_index
from quotemill.functions.dates import day as as_day
from quotemill.operators.dated import date_between
from quotemill.operators.series import latest_rows

# Above this many codes a list becomes a table and the filter a semi join.
CODE_LIST_LIMIT = 1000


def choose_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str] | None,
                  rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keys first, then the asked fields, each once."""
    names = list(dict.fromkeys([*keys, *(fields if fields is not None else df.columns)]))
    return df.select(*names).withColumnsRenamed(dict(rename or {}))


def range_scan(df: DataFrame, code: str | None = None, start=None, end=None,
               date_col: str = "day", fields: Sequence[str] | None = None,
               rename: Mapping[str, str] | None = None) -> DataFrame:
    """One code's rows in an inclusive date range; each bound only when given."""
    if code is not None:
        df = df.filter(F.col("code") == code)
    return choose_fields(date_between(df, date_col, start, end), ["code", date_col], fields, rename)


def for_codes(df: DataFrame, codes: Sequence[str] | DataFrame, col: str = "code") -> DataFrame:
    """Rows of the given codes. A short list is pushed to the scan, a long one joined; only the plan differs."""
    if isinstance(codes, DataFrame):
        wanted = codes.select(F.col(codes.columns[0]).alias("_wanted"))
    elif len(codes) <= CODE_LIST_LIMIT:
        return df.filter(F.col(col).isin(list(codes)))
    else:
        wanted = df.sparkSession.createDataFrame([(c,) for c in codes], "_wanted string")
    return df.join(wanted, F.col(col) == F.col("_wanted"), "left_semi")


def batch_scan(df: DataFrame, codes, start=None, end=None, date_col: str = "day",
               fields: Sequence[str] | None = None,
               rename: Mapping[str, str] | None = None) -> DataFrame:
    rows = for_codes(date_between(df, date_col, start, end), codes)
    return choose_fields(rows, ["code", date_col], fields, rename)


def matching(df: DataFrame, start=None, end=None, date_col: str | None = None,
             **equals) -> DataFrame:
    """Conjunction of the conditions that are given; None means 'not asked'."""
    for col, value in equals.items():
        if value is not None:
            df = df.filter(F.col(col) == F.lit(value))
    return date_between(df, date_col, start, end) if date_col else df


def transactions(df: DataFrame, user_id=None, stock_code=None, trade_date=None,
                 strategy_id=None, trade_type=None, start=None, end=None) -> DataFrame:
    return matching(df, start, end, "trade_date", user_id=user_id, stock_code=stock_code,
                    trade_date=trade_date, strategy_id=strategy_id, trade_type=trade_type)


def positions(df: DataFrame, user_id=None, stock_code=None, position_date=None,
              start=None, end=None) -> DataFrame:
    return matching(df, start, end, "position_date", user_id=user_id, stock_code=stock_code,
                    position_date=position_date)


def accounts(df: DataFrame, user_id=None, info_date=None, start=None, end=None) -> DataFrame:
    return matching(df, start, end, "info_date", user_id=user_id, info_date=info_date)


def recent(df: DataFrame, as_of: dt.date | str, days: int, date_col: str = "trade_date") -> DataFrame:
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return date_between(df, date_col, F.date_sub(as_day(as_of), days), as_of)


def active_securities(df: DataFrame, as_of: dt.date | str, listed_by: bool = False,
                      market: str | None = None, exchange: str | None = None) -> DataFrame:
    """Not delisted at ``as_of``; with ``listed_by`` also already listed then."""
    rows = df.filter(F.col("end_date").isNull() | (F.col("end_date") > as_day(as_of)))
    if listed_by:
        rows = rows.filter(F.col("start_date") <= as_day(as_of))
    return matching(rows, market=market, exchange=exchange)


def normal_securities(df: DataFrame, market: str | None = None,
                      exchange: str | None = None) -> DataFrame:
    """Stricter: status normal and no end date at all."""
    return matching(df.filter(is_active()), market=market, exchange=exchange)


def active_indices(df: DataFrame) -> DataFrame:
    return normal_securities(df).filter(is_index())


def exchange_scope(df: DataFrame, scope: str, col: str = "code") -> DataFrame:
    return df.filter(in_exchange_scope(col, scope))


def quarter_ends(df: DataFrame, col: str) -> DataFrame:
    from quotemill.functions.dates import is_quarter_end

    return df.filter(is_quarter_end(col))


def missing_factors(bars: DataFrame, suffix: str = ".BJ") -> DataFrame:
    return bars.filter(F.col("code").endswith(suffix)
                       & (F.col("adj_factor").isNull() | F.col("factor").isNull()))


def missing_factor_counts(bars: DataFrame, suffix: str = ".BJ") -> DataFrame:
    return missing_factors(bars, suffix).groupBy("code").agg(
        F.count(F.lit(1)).alias("n_missing"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


def screen(df: DataFrame, bounds: Mapping[str, Mapping[str, float]],
           date_col: str = "day") -> DataFrame:
    """Newest row per code, kept when every metric lies within its min and max."""
    rows = latest_rows(df, "code", date_col)
    for metric, limit in bounds.items():
        if limit.get("min") is not None:
            rows = rows.filter(F.col(metric) >= limit["min"])
        if limit.get("max") is not None:
            rows = rows.filter(F.col(metric) <= limit["max"])
    return rows


def sort_key(name: str, descending: bool = False) -> Column:
    """Explicit null order: engines disagree on the default."""
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def sorted_by(df: DataFrame, *order: str) -> DataFrame:
    """``'col'`` ascending, ``'-col'`` descending, NULLs last both ways."""
    return df.orderBy(*[sort_key(o.lstrip("-"), o.startswith("-")) for o in order])


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    return sorted_by(df, *order).limit(n)


def page(df: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    """One page in a total order; name a unique column last, or pages may overlap."""
    return sorted_by(df, *order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The page behind the row whose unique key is ``last`` (None: the first page).

    Reads no skipped rows, however deep the page: the key's filter reaches the scan.
    """
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def ranking(df: DataFrame, metric: str, n: int, descending: bool = True,
            date_col: str = "day") -> DataFrame:
    rows = latest_rows(df, "code", date_col).filter(F.col(metric).isNotNull())
    return rows.orderBy(sort_key(metric, descending), F.col("code").asc()).limit(n)


def search(df: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """Active securities whose code or names hold the keyword, best match first."""
    code, shown = F.col("code"), F.col("display_name")
    rank = (F.when(code == keyword, 1).when(code.startswith(keyword), 2)
            .when(shown.startswith(keyword), 3).otherwise(4))
    hit = code.contains(keyword) | shown.contains(keyword) | F.col("name").contains(keyword)
    return normal_securities(df).filter(F.coalesce(hit, F.lit(False))) \
        .orderBy(rank, code).limit(limit)


def sample_rows(df: DataFrame, n: int, key: str, seed: str = "0") -> DataFrame:
    """Exactly ``n`` rows, chosen by a hash of the key: repeatable, any partitioning."""
    shuffled = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return df.orderBy(shuffled, F.col(key)).limit(n)


def newest_bundle(tables: Mapping[str, DataFrame], codes, date_cols: Mapping[str, str],
                  n: int = 10) -> dict[str, DataFrame]:
    """The newest ``n`` rows per code of several tables, each still lazy."""
    return {name: latest_rows(for_codes(df, codes), "code", date_cols[name], n)
            for name, df in tables.items()}


def register_views(securities: DataFrame | None = None,
                   statements: Mapping[str, DataFrame] | None = None) -> list[str]:
    """Temp views ``stocks``, ``indices`` and ``<statement>_latest``."""
    from quotemill.operators.fundamentals import latest_version

    made = []
    if securities is not None:
        for view, kind in (("stocks", "stock"), ("indices", "index")):
            securities.filter(F.col("security_type") == kind).createOrReplaceTempView(view)
            made.append(view)
    for name, df in (statements or {}).items():
        latest_version(df).createOrReplaceTempView(f"{name}_latest")
        made.append(f"{name}_latest")
    return made
