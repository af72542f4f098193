"""Checks that need more than one row at a time. Each returns issue rows, possibly none."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.conditions import account_clash, bar_clash, below_zero, holding_clash, not_positive
from quotemill.functions.dates import HISTORY_START, due_report_quarter, is_quarter_end
from quotemill.functions.dates import day as as_day
from quotemill.functions.values import percent_text
from quotemill.operators import calendar as cal
from quotemill.operators import coverage as cov
from quotemill.operators import ledger as led
from quotemill.operators import scan, series
from quotemill.operators.dated import date_between, dates_in
from quotemill.quality.issues import (
    as_issues,
    counted_issue,
    first_samples,
    sample_text,
    top_samples,
    union_issues,
)
from quotemill.quality.rules import KEY_FIELDS, THRESHOLDS, UNIQUE_KEYS
from quotemill.schemas import BUY, SELL


def table_empty(df: DataFrame, table: str) -> DataFrame:
    empty = df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return as_issues(empty, severity="critical", category="completeness", table=table,
                     check="table_not_empty", description="the table has no rows",
                     count=F.col("n"))


def null_ratios(df: DataFrame, table: str, fields: Sequence[str] | None = None,
                warning: float = 0.10, critical: float = 0.30) -> DataFrame:
    counts = cov.null_counts(df, fields or KEY_FIELDS[table])
    share = F.try_divide(F.col("null_count").cast("double"), F.col("total").cast("double"))
    rows = counts.withColumn("share", share).filter(F.col("share") > warning)
    return as_issues(
        rows, severity=F.when(F.col("share") > critical, "critical").otherwise("warning"),
        category="completeness", table=table,
        check=F.concat(F.lit("null_ratio_"), F.col("column_name")),
        description=F.concat(F.col("column_name"), F.lit(" is NULL in "),
                             percent_text(F.col("share")), F.lit(" of rows")),
        count=F.col("null_count"))


def duplicate_key(df: DataFrame, table: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated keys: the surplus rows are counted in full, ten groups are shown."""
    keys = list(keys or UNIQUE_KEYS[table])
    groups = cov.duplicate_keys(df, keys)
    total = groups.agg(F.sum(F.col("n") - 1).alias("surplus")).filter(F.col("surplus") > 0)
    return as_issues(total, severity="critical", category="uniqueness", table=table,
                     check="primary_key_unique", description="rows with a repeated key",
                     count=F.col("surplus"), samples=top_samples(groups, sample_text(keys), 10))


def at_least(df: DataFrame, value: str, minimum: int, **labels) -> DataFrame:
    """Issue when a one-row figure stays below its minimum."""
    low = df.filter(F.col(value) < minimum)
    return as_issues(low, count=F.col(value), **labels)


def at_most(df: DataFrame, value: str, maximum: int, **labels) -> DataFrame:
    """Issue when a one-row figure reaches its limit."""
    return as_issues(df.filter(F.col(value) >= maximum), count=F.col(value), **labels)


def series_completeness(securities: DataFrame, prices: DataFrame, calendar: DataFrame | None,
                        as_of: dt.date | str, sample_size: int | None = None,
                        threshold: float = 0.95, seed: str = "0",
                        floor: dt.date = HISTORY_START) -> DataFrame:
    """One issue naming how many (sampled) active securities miss too many days."""
    low = _incomplete(securities, prices, calendar, as_of, sample_size, threshold, seed, floor)
    sample = F.concat("code", F.lit("("), percent_text(F.col("completeness")), F.lit(")"))
    return counted_issue(low, sample, severity="warning", category="completeness",
                         table="price_data", check="time_series_completeness",
                         description="securities with an incomplete series")


def _checked(securities, as_of, sample_size, seed):
    active = scan.active_securities(securities, as_of)
    return active if sample_size is None else scan.sample_rows(active, sample_size, "code", seed)


def _incomplete(securities, prices, calendar, as_of, sample_size, threshold, seed, floor):
    done = cov.completeness(_checked(securities, as_of, sample_size, seed), prices, calendar,
                            as_of, floor)
    return done.filter(F.col("completeness") < threshold)


def price_completeness(securities: DataFrame, prices: DataFrame, calendar: DataFrame | None,
                       as_of: dt.date | str, sample_size: int | None = None, seed: str = "0",
                       floor: dt.date = HISTORY_START) -> DataFrame:
    """Each security missing over 5% (over 20% critical), and a summary above 10% of them."""
    done = cov.completeness(_checked(securities, as_of, sample_size, seed), prices, calendar,
                            as_of, floor).filter(F.col("expected_days") > 0)
    low = done.filter(F.col("completeness") < 0.95).withColumn(
        "missing", 1.0 - F.col("completeness"))
    each = as_issues(
        low, severity=F.when(F.col("missing") > 0.2, "critical").otherwise("warning"),
        category="completeness", table="price_data", check="price_completeness",
        description=F.concat(F.lit("price series lacks "), percent_text(F.col("missing"))),
        count=F.col("expected_days") - F.col("actual_days"), samples=F.array("code"))
    share = done.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("completeness") < 0.95).alias("bad")) \
        .filter(F.col("bad") > F.col("n") * 0.1)
    summary = as_issues(
        share, severity="warning", category="completeness", table="price_data",
        check="price_completeness_summary",
        description=F.concat_ws(" ", F.col("bad").cast("string"), F.lit("of"),
                                F.col("n").cast("string"), F.lit("series incomplete")),
        count=F.col("bad"))
    return each.unionByName(summary)


def abnormal_moves(prices: DataFrame, as_of: dt.date | str, limit: float = 0.5,
                   days: int | None = 30, least: int = 1) -> DataFrame:
    """Issue when at least ``least`` moves of the last ``days`` exceed ``limit``."""
    moves = series.abnormal_moves(prices, as_of, limit, days)
    sample = F.concat("code", F.lit("@"), F.col("day").cast("string"), F.lit("("),
                      percent_text(F.col("change_ratio")), F.lit(")"))
    return counted_issue(moves, sample, n=10, least=least, severity="warning", category="accuracy",
                         table="price_data", check="abnormal_volatility",
                         description="day-over-day moves above the limit")


def recent_breadth(prices: DataFrame, as_of: dt.date | str, minimum: int, days: int = 3) -> DataFrame:
    figure = date_between(prices, "day", F.date_sub(as_day(as_of), days)).agg(
        F.count_distinct("code").alias("n"))
    return at_least(figure, "n", minimum, severity="warning", category="completeness",
                    table="price_data", check="recent_data_availability",
                    description="few securities have recent prices")


def quarter_breadth(indicators: DataFrame, as_of: dt.date | str, minimum: int) -> DataFrame:
    start = F.date_trunc("quarter", F.add_months(as_day(as_of), -3)).cast("date")
    figure = indicators.filter(F.col("statDate") >= start).agg(F.count_distinct("code").alias("n"))
    return at_least(figure, "n", minimum, severity="warning", category="completeness",
                    table="indicator_data", check="quarterly_data_completeness",
                    description="few securities have indicators since the last quarter")


def active_breadth(securities: DataFrame, as_of: dt.date | str, minimum: int) -> DataFrame:
    return at_least(cov.active_count(securities, as_of), "active_count", minimum,
                    severity="warning", category="completeness", table="stock_list",
                    check="active_stocks_coverage", description="few active securities")


# --- figures per trading day, all asked days in one job ---------------------

def _day_text(col: str = "day"):
    return F.date_format(col, "yyyyMMdd")


def price_day_coverage(securities: DataFrame, prices: DataFrame,
                       days: Sequence[dt.date | str]) -> DataFrame:
    """Days on which under 95% of active securities have a price (critical when over 20% lack one)."""
    wanted = [as_day(d) for d in days]
    expected = securities.select("code", "start_date", "end_date",
                                 F.explode(F.array(*wanted)).alias("day")).filter(
        (F.col("start_date") <= F.col("day"))
        & (F.col("end_date").isNull() | (F.col("end_date") > F.col("day")))) \
        .groupBy("day").agg(F.count(F.lit(1)).alias("expected"))
    actual = dates_in(prices, "day", days).groupBy("day").agg(
        F.count_distinct("code").alias("actual"))
    figures = expected.join(actual, "day", "left").select(
        "day", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))
    low = figures.filter(F.col("actual") < F.col("expected") * 0.95).withColumn(
        "missing", 1.0 - F.try_divide(F.col("actual").cast("double"), F.col("expected").cast("double")))
    shown = first_samples(cov.missing_on_days(securities, prices, days), ["day"], F.col("code"))
    rows = low.join(shown, "day", "left")
    return as_issues(
        rows, severity=F.when(F.col("missing") > 0.2, "critical").otherwise("warning"),
        category="completeness", table="price_data", check="price_day_coverage",
        description=F.concat(_day_text(), F.lit(" lacks "), percent_text(F.col("missing"))),
        count=F.col("expected") - F.col("actual"),
        samples=F.coalesce("samples", F.array().cast("array<string>")))


def price_day_sampled(securities: DataFrame, prices: DataFrame, days: Sequence[dt.date | str],
                      n: int = 50, seed: str = "0") -> DataFrame:
    """The same on ``n`` sampled securities: an issue when over 10% of them lack a price."""
    chosen = scan.sample_rows(securities, n, "code", seed)
    wanted = [as_day(d) for d in days]
    totals = chosen.select("code", "start_date", "end_date",
                           F.explode(F.array(*wanted)).alias("day")).filter(
        (F.col("start_date") <= F.col("day"))
        & (F.col("end_date").isNull() | (F.col("end_date") > F.col("day")))) \
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    missing = cov.missing_on_days(chosen, prices, days).groupBy("day").agg(
        F.count(F.lit(1)).alias("missing"))
    bad = totals.join(missing, "day").filter(F.col("missing") > F.col("n") * 0.1)
    return as_issues(
        bad, severity="warning", category="completeness", table="price_data",
        check="price_day_sampled",
        description=F.concat(_day_text(), F.lit(": "), F.col("missing").cast("string"),
                             F.lit(" of "), F.col("n").cast("string"), F.lit(" sampled lack a price")),
        count=F.col("missing"))


def price_day_logic(prices: DataFrame, days: Sequence[dt.date | str]) -> DataFrame:
    bad = dates_in(prices, "day", days).filter(bar_clash())
    per_day = bad.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return as_issues(per_day, severity="critical", category="accuracy", table="price_data",
                     check="price_day_logic",
                     description=F.concat(_day_text(), F.lit(" has illogical prices")),
                     count=F.col("n"))


def daily_alignment(prices: DataFrame, other: DataFrame, table: str, other_date: str = "day",
                    days: Sequence[dt.date | str] | None = None,
                    skip_suffix: str | None = ".BJ") -> DataFrame:
    """Days on which over 10% of the priced codes lack a row in ``other`` (over 50% critical)."""
    rows = prices if skip_suffix is None else prices.filter(~F.col("code").endswith(skip_suffix))
    if days is not None:
        rows, other = dates_in(rows, "day", days), dates_in(other, other_date, days)
    totals = rows.groupBy("day").agg(F.count(F.lit(1)).alias("total"))
    missing = cov.prices_without(rows, other, other_date, skip_suffix=None)
    per_day = missing.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    bad = totals.join(per_day, "day").withColumn("share", share).filter(F.col("share") > 0.1)
    rows = bad.join(first_samples(missing, ["day"], F.col("code")), "day", "left")
    return as_issues(
        rows, severity=F.when(F.col("share") > 0.5, "critical").otherwise("warning"),
        category="completeness", table=table, check=f"{table}_day_coverage",
        description=F.concat(_day_text(), F.lit(" lacks "), percent_text(F.col("share"))),
        count=F.col("n"), samples=F.coalesce("samples", F.array().cast("array<string>")))


def report_coverage(securities: DataFrame, indicators: DataFrame, days: Sequence[dt.date | str],
                    sample_size: int | None = None, seed: str = "0") -> DataFrame:
    """Share of active securities with the quarterly report due at each day.

    All securities: below 70% is an issue (critical when over half lack it). A sample: an
    issue when over 30% lack it.
    """
    base = securities if sample_size is None else scan.sample_rows(securities, sample_size, "code", seed)
    wanted = [as_day(d) for d in days]
    due = base.select("code", "start_date", "end_date", F.explode(F.array(*wanted)).alias("day")) \
        .filter((F.col("start_date") <= F.col("day"))
                & (F.col("end_date").isNull() | (F.col("end_date") > F.col("day")))) \
        .select("code", "day", due_report_quarter("day").alias("quarter"))
    quarters = F.array(*[due_report_quarter(d) for d in wanted])
    have = indicators.filter(F.array_contains(quarters, F.col("statDate"))) \
        .select("code", F.col("statDate").alias("quarter")).distinct()
    expected = due.groupBy("day", "quarter").agg(F.count(F.lit(1)).alias("expected"))
    if sample_size is None:
        found = have.groupBy("quarter").agg(F.count(F.lit(1)).alias("actual"))
        figures = expected.join(found, "quarter", "left")
    else:
        found = due.join(have, ["code", "quarter"], "left_semi").groupBy("day", "quarter").agg(
            F.count(F.lit(1)).alias("actual"))
        figures = expected.join(found, ["day", "quarter"], "left")
    figures = figures.withColumn("actual", F.coalesce("actual", F.lit(0)))
    missing = 1.0 - F.try_divide(F.col("actual").cast("double"), F.col("expected").cast("double"))
    limit = 0.3
    bad = figures.withColumn("missing", missing).filter(F.col("missing") > limit)
    severity = F.when(F.col("missing") > 0.5, "critical").otherwise("warning") \
        if sample_size is None else "warning"
    return as_issues(
        bad, severity=severity, category="completeness", table="indicator_data",
        check="report_coverage" if sample_size is None else "report_coverage_sampled",
        description=F.concat(_day_text(), F.lit(": quarter "), F.col("quarter").cast("string"),
                             F.lit(" lacks "), percent_text(F.col("missing"))),
        count=F.col("expected") - F.col("actual"))


def quarterly_freshness(indicators: DataFrame, as_of: dt.date | str, since: dt.date | str,
                        min_rows: int = 3000, quarters: int = 4, skip_suffix: str = ".BJ") -> DataFrame:
    """Empty table, stale newest quarter, missing or thin quarters, eps or roe mostly NULL."""
    spark = indicators.sparkSession
    rows = indicators.filter(~F.col("code").endswith(skip_suffix))
    recent = rows.filter(F.col("statDate") >= as_day(since))
    per_quarter = cov.count_by(recent.filter(is_quarter_end("statDate")), "statDate")
    label = {"category": "completeness", "table": "indicator_data"}

    stale = per_quarter.agg(F.max("statDate").alias("newest")).filter(
        F.col("newest") < F.date_sub(as_day(as_of), 180))
    expected = spark.range(1).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(quarters - 1)),
        lambda i: F.last_day(F.add_months(due_report_quarter(as_day(as_of)), i * -3)))).alias("quarter"))
    held = expected.join(per_quarter, F.col("quarter") == F.col("statDate"), "left")
    missing = held.filter(F.col("n").isNull())
    thin = held.filter(F.col("n") < min_rows)
    gone = missing.agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(
        F.col("quarter").cast("string"))).alias("samples")).filter(F.col("k") > 0)
    nulls = cov.null_counts(recent, ["eps", "roe"]).withColumn(
        "share", F.try_divide(F.col("null_count").cast("double"), F.col("total").cast("double"))) \
        .filter(F.col("share") > 0.5)
    return union_issues([
        table_empty(rows, "indicator_data"),
        as_issues(stale, severity="warning", check="quarter_stale", description=F.concat(
            F.lit("newest quarter is "), F.col("newest").cast("string")), **label),
        as_issues(gone, severity="warning", check="quarters_missing",
                  description="expected quarters have no rows", count=F.col("k"),
                  samples=F.col("samples"), **label),
        as_issues(thin, severity="warning", check="quarter_thin", description=F.concat(
            F.lit("few rows for "), F.col("quarter").cast("string")), count=F.col("n"), **label),
        as_issues(nulls, severity="warning", category="accuracy", table="indicator_data",
                  check=F.concat(F.lit("mostly_null_"), F.col("column_name")),
                  description=F.concat(F.col("column_name"), F.lit(" is mostly NULL")),
                  count=F.col("null_count")),
    ], spark)


def master_basics(securities: DataFrame) -> DataFrame:
    """Empty master, NULL codes, NULL names (critical above 10%)."""
    counts = cov.null_counts(securities, ["code", "display_name"]).filter(F.col("null_count") > 0)
    share = F.try_divide(F.col("null_count").cast("double"), F.col("total").cast("double"))
    severe = (F.col("column_name") == "code") | (share > 0.1)
    nulls = as_issues(
        counts, severity=F.when(severe, "critical").otherwise("warning"), category="completeness",
        table="stock_list", check=F.concat(F.lit("null_"), F.col("column_name")),
        description=F.concat(F.col("column_name"), F.lit(" is NULL")), count=F.col("null_count"))
    return table_empty(securities, "stock_list").unionByName(nulls)


# --- account tables ---------------------------------------------------------

def unknown_stock_codes(facts: DataFrame, securities: DataFrame, table: str = "user_transactions",
                        col: str = "stock_code") -> DataFrame:
    """Rows of codes the master lacks; counted per code before any join."""
    bad = cov.unknown_codes(facts, securities, col)
    total = bad.agg(F.sum("n").alias("total")).filter(F.col("total") > 0)
    return as_issues(total, severity="warning", category="completeness", table=table,
                     check="stock_code_reference_integrity",
                     description="codes the security master lacks", count=F.col("total"),
                     samples=top_samples(bad, F.col(col)))


def non_trading_days(df: DataFrame, calendar: DataFrame, table: str, date_col: str,
                     start: dt.date | str, check: str, severity: str = "warning") -> DataFrame:
    """Rows dated on closed days. Counted per date first; only dates meet the calendar."""
    per_day = cov.count_by(df.filter(F.col(date_col).isNotNull()), date_col)
    bad = cal.off_calendar(per_day, calendar, date_col, start)
    total = bad.agg(F.sum("n").alias("total")).filter(F.col("total") > 0)
    return as_issues(total, severity=severity, category="completeness", table=table, check=check,
                     description="rows dated on a day without trading", count=F.col("total"),
                     samples=top_samples(bad, F.col(date_col).cast("string")))


def missing_days(df: DataFrame, calendar: DataFrame, table: str, date_col: str,
                 start: dt.date | str) -> DataFrame:
    gaps = cal.missing_snapshot_days(df, calendar, date_col, start)
    return counted_issue(gaps, F.col("day").cast("string"), severity="warning",
                         category="completeness", table=table, check="trading_day_completeness",
                         description="trading days without a snapshot")


def snapshot_gaps(positions: DataFrame, max_gap: int = 7) -> DataFrame:
    gaps = led.snapshot_gaps(positions, max_gap)
    return counted_issue(gaps, sample_text(["user_id", "position_date", "prev_date", "gap_days"]),
                         severity="warning", category="completeness", table="user_positions",
                         check="position_continuity_check",
                         description="gaps between consecutive snapshots")


def snapshot_gaps_per_user(positions: DataFrame, max_gap: int = 7) -> DataFrame:
    counts = led.snapshot_gap_counts(positions, max_gap)
    return as_issues(counts, severity="warning", category="completeness", table="user_positions",
                     check="position_gaps", description=F.concat(
                         F.lit("user "), F.col("user_id"), F.lit(" has gaps between snapshots")),
                     count=F.col("gap_count"))


def alignment_with_price(prices: DataFrame, valuation: DataFrame, securities: DataFrame,
                         as_of: dt.date | str, limit: int = 1000, days: int = 30) -> DataFrame:
    """Recent prices inside listing life without a valuation; an issue from ``limit`` on."""
    since = F.date_sub(as_day(as_of), days)
    recent, valuation = date_between(prices, "day", since), date_between(valuation, "day", since)
    bad = cov.prices_without(cov.within_listing(recent, securities), valuation, skip_suffix=None)
    return at_most(bad.agg(F.count(F.lit(1)).alias("n")), "n", limit, severity="warning",
                   category="completeness", table="valuation_data", check="data_alignment_with_price",
                   description="prices without a valuation")


def account_tables_on(dates: Sequence[dt.date | str], transactions: DataFrame | None = None,
                      positions: DataFrame | None = None, accounts: DataFrame | None = None,
                      spark=None) -> DataFrame:
    """The account tables on chosen dates: nothing there, or rows that contradict themselves."""
    parts = []

    def look(df, table, date_col, bad_rule, check, severity, may_be_empty):
        hit = dates_in(df, date_col, dates).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(bad_rule).alias("bad"))
        if not may_be_empty:
            parts.append(as_issues(
                hit.filter(F.col("n") == 0), severity="warning", category="completeness",
                table=table, check="no_rows_on_dates", count=F.col("n"),
                description="no rows on any of the chosen dates"))
        parts.append(as_issues(
            hit.filter(F.col("bad") > 0), severity=severity, category="accuracy", table=table,
            check=check, description="wrong rows on the chosen dates", count=F.col("bad")))

    if positions is not None:
        look(positions, "user_positions", "position_date",
             holding_clash(), "position_logic_on_dates", "critical", False)
    if accounts is not None:
        look(accounts, "user_account_info", "info_date",
             account_clash(), "asset_balance_on_dates", "warning", False)
    if transactions is not None:
        look(transactions, "user_transactions", "trade_date",
             not_positive("quantity", "price") | ~F.col("trade_type").isin(BUY, SELL),
             "trade_logic_on_dates", "critical", True)
    return union_issues(parts, spark or next(
        d for d in (transactions, positions, accounts) if d is not None).sparkSession)


def load_rejects(feed: DataFrame, table: str = "price_data") -> DataFrame:
    """Landed rows with negative volume or money; they are loaded and reported."""
    bad = feed.filter(below_zero("volume", "money"))
    kind = F.when(F.col("volume") < 0, "negative volume").otherwise("negative money")
    return as_issues(bad, severity="warning", category="accuracy", table=table,
                     check="negative_feed_value", description=kind,
                     samples=F.array(F.concat("code", F.lit("@"), F.col("day").cast("string"))))


def account_value_check(accounts: DataFrame, positions: DataFrame, tolerance: float = 10.0) -> DataFrame:
    bad = led.account_position_check(accounts, positions, tolerance)
    return counted_issue(bad, sample_text(["user_id", "info_date"]), severity="warning",
                         category="accuracy", table="user_account_info", check="account_value",
                         description="market value is not the sum of holdings")


def market_cap_check(prices: DataFrame, valuation: DataFrame, **units) -> DataFrame:
    from quotemill.operators.fundamentals import market_cap_errors

    bad = market_cap_errors(prices, valuation, **units)
    return counted_issue(bad, sample_text(["code", "day"]), severity="warning",
                         category="accuracy", table="valuation_data", check="market_cap",
                         description="market cap is not price times shares")


def standard_thresholds(overrides: Mapping | None = None) -> dict:
    return {**THRESHOLDS, **(overrides or {})}
