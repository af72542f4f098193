"""Runs the standard rule set over whatever tables are given."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.dates import day as as_day
from quotemill.operators import coverage as cov
from quotemill.operators import day_maps
from quotemill.operators.calendar import trading_calendar
from quotemill.operators.dated import date_between
from quotemill.quality import checks
from quotemill.quality.issues import union_issues
from quotemill.quality.rules import KEY_FIELDS, UNIQUE_KEYS, judge_rows, rules_at, standard_rules, statement_rules
from quotemill.schemas import WATERMARK
from quotemill.session import stored


def _has(tables: Mapping[str, DataFrame], judged: Sequence[str], name: str, *columns: str) -> bool:
    return name in judged and set(columns) <= set(tables[name].columns)


def run_checks(tables: Mapping[str, DataFrame], as_of: dt.date | str, level: str = "quick",
               only: Sequence[str] | None = None, thresholds: Mapping | None = None,
               seed: str = "0") -> DataFrame:
    """All issues of the given tables as one lazy DataFrame.

    ``tables`` maps table names to frames; rules whose reference table is not given are left
    out. ``only`` restricts which tables are judged, not which may be referred to.
    """
    unknown = [t for t in (only or []) if t not in tables]
    if unknown:
        raise ValueError(f"tables not given: {unknown}")
    t = checks.standard_thresholds(thresholds)
    spark = next(iter(tables.values())).sparkSession
    judged = [n for n in tables if only is None or n in only]
    securities, prices = tables.get("stock_list"), tables.get("price_data")
    # The days each code is held, written once as bitmaps: completeness and calendar come from them, not
    # from the bars. This is the one job that runs before the issues are asked for.
    maps = stored(day_maps.day_maps(prices), "day-maps") if prices is not None else None
    calendar = None if maps is None else day_maps.days_of(day_maps.merged(maps, keys=()))
    rules = rules_at(level, [*standard_rules(t, str(as_of)), *statement_rules()])
    parts: list[DataFrame] = []

    for name in judged:
        df = tables[name]
        own = [r for r in rules if r.table == name]
        everywhere = [r for r in own if not r.listed_only]
        listed = [r for r in own if r.listed_only]
        fields = [c for c in KEY_FIELDS.get(name, []) if c in df.columns] if level == "standard" else []
        if everywhere:
            parts.append(judge_rows(df, everywhere, not_empty=True, key_fields=fields))
        else:
            parts.append(checks.table_empty(df, name))
        if listed:
            scope = df if securities is None else cov.within_listing(df, securities)
            parts.append(judge_rows(scope, listed))
        if name in UNIQUE_KEYS:
            parts.append(checks.duplicate_key(df, name))
        if fields and not everywhere:
            parts.append(checks.null_ratios(df, name, fields))

    since = t["user_data_start_date"]
    if "stock_list" in judged:
        parts.append(checks.active_breadth(securities, as_of, t["min_active_securities"]))
    if "price_data" in judged:
        parts.append(checks.recent_breadth(prices, as_of, t["min_recent_codes"]))
        if securities is not None:
            parts.append(checks.series_completeness(
                securities, maps, None, as_of, t["sample_size"], t["completion_threshold"], seed))
        if level == "standard" and securities is not None:
            parts.append(checks.price_completeness(securities, maps, None, as_of, t["sample_size"], seed))
        if level == "standard":
            scope = prices if securities is None else cov.within_listing(
                date_between(prices, "day", F.date_sub(as_day(as_of), 30)), securities)
            parts.append(checks.abnormal_moves(scope, as_of, t["price_change_limit"],
                                               least=t["max_volatile_moves"]))
    if "valuation_data" in judged and prices is not None and securities is not None:
        parts.append(checks.alignment_with_price(prices, tables["valuation_data"], securities,
                                                 as_of, t["max_missing_valuations"]))
    if level == "standard" and prices is not None and _has(
            tables, judged, "valuation_data", "market_cap", "capitalization"):
        parts.append(checks.market_cap_check(prices, tables["valuation_data"]))
    if level == "standard" and "user_positions" in tables and _has(
            tables, judged, "user_account_info", "position_market_value"):
        parts.append(checks.account_value_check(tables["user_account_info"], tables["user_positions"]))
    if "indicator_data" in judged:
        parts.append(checks.quarter_breadth(tables["indicator_data"], as_of, t["min_quarter_codes"]))
    if "user_transactions" in judged:
        df = tables["user_transactions"]
        if calendar is not None:
            parts.append(checks.non_trading_days(df, calendar, "user_transactions", "trade_date",
                                                 since, "non_trading_day_transactions", "critical"))
        if securities is not None:
            parts.append(checks.unknown_stock_codes(df, securities))
    for name in ("user_positions", "user_account_info"):
        if name in judged and calendar is not None:
            df, date_col = tables[name], WATERMARK[name]
            parts.append(checks.missing_days(df, calendar, name, date_col, since))
            parts.append(checks.non_trading_days(df, calendar, name, date_col, since,
                                                 "non_trading_day_check"))
    if "user_positions" in judged:
        parts.append(checks.snapshot_gaps(tables["user_positions"], t["max_gap_days"]))
    return union_issues(parts, spark)


def routine(tables: Mapping[str, DataFrame], as_of: dt.date | str, recent_days: int = 3,
            history_days: int = 30, seed: str = "0", thresholds: Mapping | None = None) -> DataFrame:
    """Daily routine: the newest trading days before ``as_of`` and a sample of last year's days.

    All securities are judged on the chosen days. The days are read once (at most
    ``recent_days + history_days`` dates) to name them in the checks; the newest week is left to the
    recent part, and ``as_of`` itself, still unfinished, to the next run.
    """
    t = checks.standard_thresholds(thresholds)
    securities, prices = tables["stock_list"], tables["price_data"]
    spark = prices.sparkSession
    days = stored(trading_calendar(prices, end=F.date_sub(as_day(as_of), 1)), "trading-days", 1)
    recent = [r.day for r in days.orderBy(F.col("day").desc()).limit(recent_days).collect()]
    edge = days.orderBy(F.col("day").desc()).limit(8).agg(F.min("day")).scalar()
    pool = days.filter((F.col("day") <= edge) & (F.col("day") >= F.date_sub(edge, 365)))
    from quotemill.operators.scan import sample_rows

    past = [r.day for r in sample_rows(pool.select("day"), history_days, "day", seed).collect()]
    parts = [checks.master_basics(securities)]
    if recent + past:
        chosen = sorted({*recent, *past})
        parts += [checks.price_day_coverage(securities, prices, chosen),
                  checks.price_day_logic(prices, chosen)]
    if "valuation_data" in tables and recent + past:
        parts.append(checks.daily_alignment(prices, tables["valuation_data"], "valuation_data",
                                            days=sorted({*recent, *past})))
    if "indicator_data" in tables:
        since = F.trunc(F.add_months(F.lit(as_of).cast("date"), -12), "year")
        parts.append(checks.quarterly_freshness(tables["indicator_data"], as_of, since,
                                                t["min_quarter_rows"]))
        if recent:
            parts.append(checks.report_coverage(securities, tables["indicator_data"], recent[:1]))
    users = {k: tables.get(n) for k, n in (("transactions", "user_transactions"),
                                          ("positions", "user_positions"),
                                          ("accounts", "user_account_info"))}
    if any(v is not None for v in users.values()) and recent + past:
        parts.append(checks.account_tables_on(sorted({*recent, *past}), spark=spark, **users))
    return union_issues(parts, spark)
