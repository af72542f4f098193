"""Counts, coverage, latest dates and key uniqueness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.codes import is_active
from quotemill.functions.dates import HISTORY_START, due_report_quarter
from quotemill.functions.dates import day as as_day
from quotemill.functions.values import round_to
from quotemill.operators import day_maps
from quotemill.operators.dated import date_between, dates_in
from quotemill.operators.scan import active_securities, for_codes


def count_by(df: DataFrame, *keys: str | Column, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def securities_by_market(securities: DataFrame) -> DataFrame:
    """Active securities per exchange and board, with a joined label."""
    counts = count_by(securities.filter(is_active()), "exchange", "market")
    return counts.withColumn("label", F.concat_ws("_", "exchange", "market"))


def suffix_bucket(code: str = "code") -> Column:
    return F.when(F.col(code).rlike(r"\.(SH|SZ|BJ)$"),
                  F.substring(F.col(code), -2, 2)).otherwise(F.lit("other"))


def end_date_category(as_of: dt.date | str) -> Column:
    end = F.col("end_date")
    return (F.when(end.isNull(), F.lit("null"))
            .when(end > as_day(as_of), F.lit("future")).otherwise(F.lit("past")))


def price_coverage(bars: DataFrame, *keys: str) -> DataFrame:
    """Rows, first and last day; over all rows or per key."""
    stats = [F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"),
             F.max("day").alias("last_day")]
    return bars.groupBy(*keys).agg(*stats) if keys else bars.agg(*stats)


def latest_dates(df: DataFrame, codes: DataFrame | Sequence[str], date_col: str = "day") -> DataFrame:
    """Newest date of every asked code; NULL where the table has none. One pass."""
    if not isinstance(codes, DataFrame):
        codes = df.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    newest = df.groupBy("code").agg(F.max(date_col).alias("max_date"))
    return codes.select("code").distinct().join(newest, "code", "left")


def latest_date(df: DataFrame, date_col: str = "day") -> DataFrame:
    return df.agg(F.max(date_col).alias("max_date"))


def existing_codes(df: DataFrame) -> DataFrame:
    return df.select("code").distinct().orderBy(F.col("code").asc_nulls_last())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return count_by(df, *keys, out="n").filter(F.col("n") > 1)


def duplicate_surplus(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with repeats, and rows beyond the first of each."""
    return duplicate_keys(df, keys).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs of many columns in one scan, as ``column_name, null_count, total``."""
    wide = df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(["total"], list(columns), "column_name", "null_count") \
        .select("column_name", "null_count", "total")


def loaded_per_code(loaded: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows loaded per requested code, with a status."""
    counts = count_by(loaded, "code", out="records_count")
    n = F.coalesce("records_count", F.lit(0)).cast("bigint")
    return codes.select("code").distinct().join(counts, "code", "left").select(
        "code", n.alias("records_count"),
        F.when(n > 0, F.lit("successful")).otherwise(F.lit("failed")).alias("status"))


def load_summary(per_code: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "successful")
    total = F.count(F.lit(1))
    return per_code.agg(
        total.alias("total"), ok.alias("successful"), (total - ok).alias("failed"),
        F.coalesce(F.sum("records_count"), F.lit(0)).cast("bigint").alias("records"),
        round_to(F.try_divide(ok.cast("double"), total.cast("double")), 6).alias("success_rate"))


def codes_with_recent_data(df: DataFrame, since: dt.date | str, date_col: str = "day",
                           approximate: bool = False) -> DataFrame:
    rows = date_between(df, date_col, since)
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(counter("code").alias("n_codes"))


def rows_on_dates(df: DataFrame, dates: Sequence[dt.date | str], date_col: str) -> DataFrame:
    return count_by(dates_in(df, date_col, dates), date_col)


def reports_per_quarter(df: DataFrame, since: dt.date | str, stat_col: str = "statDate") -> DataFrame:
    from quotemill.functions.dates import is_quarter_end

    rows = df.filter((F.col(stat_col) >= as_day(since)) & is_quarter_end(stat_col))
    return count_by(rows, stat_col).orderBy(F.col(stat_col).desc_nulls_last())


def missing_quarters(df: DataFrame, as_of: dt.date | str, n: int = 4,
                     stat_col: str = "statDate") -> DataFrame:
    """The last ``n`` due quarter ends for which the table has no row."""
    spark = df.sparkSession
    due = spark.range(1).select(due_report_quarter(as_day(as_of)).alias("q"))
    expected = due.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.last_day(F.add_months(F.col("q"), i * -3)))).alias("quarter"))
    have = df.select(F.col(stat_col).alias("quarter")).distinct()
    return expected.join(have, "quarter", "left_anti")


# --- references and listing life --------------------------------------------

def within_listing(facts: DataFrame, securities: DataFrame, date_col: str = "day") -> DataFrame:
    """Facts of known securities dated inside their listing life."""
    life = securities.select(F.col("code").alias("_code"), F.col("start_date").alias("_from"),
                             F.col("end_date").alias("_to"))
    cond = ((F.col("code") == F.col("_code")) & (F.col(date_col) >= F.col("_from"))
            & (F.col("_to").isNull() | (F.col(date_col) <= F.col("_to"))))
    return facts.join(life, cond).drop("_code", "_from", "_to")


def unknown_codes(facts: DataFrame, securities: DataFrame, col: str = "stock_code") -> DataFrame:
    """Codes the master lacks, with their row counts. Facts are counted before the join."""
    seen = count_by(facts.filter(F.col(col).isNotNull()), col)
    master = securities.select(F.col("code").alias("_known"))
    return seen.join(master, F.col(col) == F.col("_known"), "left_anti")


def rows_with_unknown_code(facts: DataFrame, securities: DataFrame,
                           col: str = "stock_code") -> DataFrame:
    """The rows behind ``unknown_codes``; rows without a code count as unknown."""
    bad = unknown_codes(facts, securities, col).select(F.col(col).alias("_bad"))
    return facts.join(bad, F.col(col) == F.col("_bad"), "left_semi") \
        .unionByName(facts.filter(F.col(col).isNull()))


def prices_without(prices: DataFrame, other: DataFrame, other_date: str = "day",
                   skip_suffix: str | None = ".BJ") -> DataFrame:
    """(code, day) of prices that the other daily table lacks."""
    rows = prices if skip_suffix is None else prices.filter(~F.col("code").endswith(skip_suffix))
    have = other.select("code", F.col(other_date).alias("day"))
    return rows.select("code", "day").join(have, ["code", "day"], "left_anti")


def missing_on_days(securities: DataFrame, prices: DataFrame,
                    days: Sequence[dt.date | str]) -> DataFrame:
    """Securities active on each given day that have no price then."""
    wanted = [as_day(d) for d in days]
    expected = securities.select(
        "code", "start_date", "end_date", F.explode(F.array(*wanted)).alias("day")).filter(
        (F.col("start_date") <= F.col("day"))
        & (F.col("end_date").isNull() | (F.col("end_date") > F.col("day")))).select("code", "day")
    have = dates_in(prices, "day", days).select("code", "day")
    return expected.join(have, ["code", "day"], "left_anti")


def missing_trading_days(securities: DataFrame, prices: DataFrame,
                         calendar: DataFrame | None = None) -> DataFrame:
    """Every (code, day) a security was active on a trading day without a price.

    Without a calendar every day with a price is a trading day. Bars become day bitmaps in one scan and one
    shuffle (``prices`` may be stored maps); a security's expected words lack the held ones, and only
    missing days are opened.
    """
    maps = day_maps.maps_of(prices)
    until = F.coalesce(F.date_sub("end_date", 1), F.lit("9999-12-31").cast("date"))
    alive = F.filter(
        F.transform("_words", lambda w: F.struct(w["word"].alias("word"), w["bits"].bitwiseAND(
            day_maps.span_mask(w["word"], F.col("start_date"), until)).alias("bits"))),
        lambda w: w["bits"] != 0)
    known = securities.filter(F.col("code").isNotNull()).select("code", "start_date", "end_date")
    expected = day_maps.with_open_words(known, maps if calendar is None else calendar) \
        .select("code", F.inline(alive)) \
        .groupBy("code", "word").agg(F.bit_or("bits").alias("bits"))
    return day_maps.missing(expected, maps)


def active_per_day(securities: DataFrame, calendar: DataFrame) -> DataFrame:
    """How many securities are active on each trading day, by a running count of events.

    Listings add one, delistings take one off; only per-date counts are ordered.
    """
    starts = securities.filter(F.col("start_date").isNotNull()) \
        .groupBy(F.col("start_date").alias("day")).agg(F.count(F.lit(1)).alias("d"))
    ends = securities.filter(F.col("end_date").isNotNull() & F.col("start_date").isNotNull()) \
        .groupBy(F.greatest("end_date", "start_date").alias("day")) \
        .agg((-F.count(F.lit(1))).alias("d"))
    marks = calendar.select("day", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("t"))
    events = starts.withColumn("t", F.lit(False)).unionByName(ends.withColumn("t", F.lit(False))) \
        .unionByName(marks)
    daily = events.groupBy("day").agg(F.sum("d").alias("d"), F.max("t").alias("t"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", F.sum("d").over(upto).cast("bigint").alias("active"), "t") \
        .filter("t").select("day", "active")


def day_coverage(securities: DataFrame, prices: DataFrame,
                 calendar: DataFrame | None = None) -> DataFrame:
    """Securities priced against securities active, per trading day (each day with a price, by default).

    Bitmaps hold a code once per day, so priced securities are plain counts, combined on the map side.
    """
    priced = day_maps.days_of(day_maps.maps_of(prices)).groupBy("day").agg(
        F.count(F.lit(1)).alias("actual"))
    days = priced if calendar is None else calendar
    return active_per_day(securities, days).join(priced, "day", "left").select(
        "day", F.col("active").alias("expected"),
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))


def completeness(securities: DataFrame, prices: DataFrame, calendar: DataFrame | None,
                 as_of: dt.date | str, floor: dt.date = HISTORY_START) -> DataFrame:
    """Per security: days held over trading days expected, at most 1; nothing expected is 1.

    Without a calendar every day with a price is a trading day. Days come from bitmaps: a repeated bar
    counts once, and securities repeated with the same life are one row. The calendar's newest day and running counts
    are made once, so a security costs two look-ups and not a walk over the calendar.
    """
    maps = day_maps.maps_of(prices)
    open_days = day_maps.counted_calendar(maps if calendar is None else calendar, as_day(as_of))
    known = securities.select("code", "start_date", "end_date").withColumn("_cal", open_days)
    last = F.col("_cal.newest")
    spans = known.select(
        "code", "_cal", F.greatest(F.coalesce("start_date", F.lit(floor)), F.lit(floor)).alias("from_day"),
        F.least(F.coalesce(F.col("end_date"), last), last).alias("to_day"))
    expected = spans.withColumn("expected_days", day_maps.calendar_days_in(
        F.col("_cal"), F.col("from_day"), F.col("to_day"))).drop("_cal")
    done = day_maps.held_between(expected, maps, "from_day", "to_day")
    ratio = F.coalesce(F.least(F.lit(1.0), F.try_divide(
        F.col("actual_days").cast("double"), F.col("expected_days").cast("double"))), F.lit(1.0))
    return done.select("code", "from_day", "to_day", "expected_days", "actual_days",
                       round_to(ratio, 6).alias("completeness"))


def incomplete_indices(prices: DataFrame, codes: DataFrame, start: dt.date | str,
                       end: dt.date | str) -> DataFrame:
    """Indices to load again: too few bars (80% of 245 a year) or a first bar 60 days late."""
    stats = price_coverage(prices, "code")
    need = F.floor(F.datediff(as_day(end), as_day(start)) * 245 / 365 * 0.8)
    rows = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    late = F.coalesce(F.col("first_day") > F.date_add(as_day(start), 60), F.lit(False))
    return codes.select("code").distinct().join(stats, "code", "left").select(
        "code", rows.alias("n_rows"), "first_day",
        F.when(rows == 0, F.lit("empty")).when(rows < need, F.lit("short"))
        .when(late, F.lit("late")).alias("reason")).filter(F.col("reason").isNotNull())


def with_master_names(codes: DataFrame, securities: DataFrame) -> DataFrame:
    """Codes with their names; the code itself where the master has none."""
    names = securities.select("code", "name", "display_name", "exchange", "market")
    return codes.select("code").distinct().join(names, "code", "left") \
        .withColumn("name", F.coalesce("name", "code")) \
        .withColumn("display_name", F.coalesce("display_name", "code"))


def security_info(securities: DataFrame, codes) -> DataFrame:
    return for_codes(securities, codes)


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table, one row each."""
    parts = [df.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(name).alias("table_name"), "record_count",
        F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def active_count(securities: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Active by date and status: the base figure of several thresholds."""
    return active_securities(securities, as_of).filter(F.col("status") == "normal").agg(
        F.count(F.lit(1)).alias("active_count"))
