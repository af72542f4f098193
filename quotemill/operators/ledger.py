"""Trade ledger, holdings and account analytics.

Every figure is a grouped aggregate with partial sums on the map side, so one user or one
stock holding much of the ledger costs a few partial rows in the shuffle, not its trades.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import trades as tf
from quotemill.functions.codes import has_known_suffix, trade_type_name
from quotemill.functions.conditions import CASH, HOLDING, below_zero, gap, holding_clash, not_positive, present
from quotemill.functions.dates import day as as_day
from quotemill.functions.values import money_avg, money_sum, round_to, sum_when
from quotemill.operators.dated import date_between
from quotemill.operators.series import latest_rows
from quotemill.schemas import BUY, SELL


def signed(col: str) -> Column:
    """Bought as it is, sold below zero."""
    return F.when(F.col("trade_type") == BUY, F.col(col)).otherwise(-F.col(col))


def net_positions(ledger: DataFrame, end: dt.date | str | None = None,
                  user_id: str | None = None) -> DataFrame:
    """What each user still holds: bought minus sold, only where something is left."""
    rows = date_between(ledger, "trade_date", None, end)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.groupBy("user_id", "stock_code").agg(
        money_sum(signed("quantity")).alias("total_quantity"),
        money_sum(signed("net_amount")).alias("total_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
    ).filter(F.col("total_quantity") > 0)


def daily_summary(ledger: DataFrame, on: dt.date | str | None = None,
                  user_id: str | None = None) -> DataFrame:
    """Per user, stock and side (and day, unless one is given): count and sums."""
    rows = ledger if user_id is None else ledger.filter(F.col("user_id") == user_id)
    keys = ["user_id", "stock_code", "trade_type"]
    if on is None:
        keys = ["trade_date", *keys]
    else:
        rows = rows.filter(F.col("trade_date") == as_day(on))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        *[money_sum(c).alias(f"total_{c}") for c in
          ("quantity", "amount", "commission", "stamp_tax", "other_fees", "net_amount")])
    return out.withColumn("trade_type_name", trade_type_name("trade_type"))


def user_summary(ledger: DataFrame, user_id: str | None = None, start=None, end=None) -> DataFrame:
    """Per user and stock: both sides, fees, first and last trade date."""
    rows = date_between(ledger, "trade_date", start, end)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    buy, sell = F.col("trade_type") == BUY, F.col("trade_type") == SELL
    fees = F.col("commission") + F.col("stamp_tax") + F.col("other_fees")
    return rows.groupBy("user_id", "stock_code").agg(
        F.count(F.lit(1)).alias("trade_count"),
        sum_when(buy, "quantity").alias("buy_quantity"),
        sum_when(sell, "quantity").alias("sell_quantity"),
        sum_when(buy, "amount").alias("buy_amount"),
        sum_when(sell, "amount").alias("sell_amount"),
        money_sum(fees).alias("total_fees"),
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("stock_code").alias("n_stocks"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count_if(F.col("trade_type") == BUY).alias("n_buys"),
        F.count_if(F.col("trade_type") == SELL).alias("n_sells"))


def position_book(positions: DataFrame, on: dt.date | str | None = None,
                  user_id: str | None = None) -> DataFrame:
    """Rows of one date, or of each user's newest date when none is given."""
    rows = positions if user_id is None else positions.filter(F.col("user_id") == user_id)
    if on is not None:
        return date_between(rows, "position_date", on, on)
    newest = rows.groupBy("user_id").agg(F.max("position_date").alias("position_date"))
    return rows.join(newest, ["user_id", "position_date"], "left_semi")


def position_summary(positions: DataFrame, on: dt.date | str | None = None,
                     user_id: str | None = None) -> DataFrame:
    held = position_book(positions, on, user_id).filter(F.col("position_quantity") > 0)
    return held.groupBy("user_id", "position_date").agg(
        F.count(F.lit(1)).alias("total_positions"),
        F.count_distinct("stock_code").alias("unique_stocks"),
        F.sum(F.col("position_quantity").cast("bigint")).alias("total_quantity"),
        money_sum("market_value").alias("total_market_value"),
        money_sum("unrealized_pnl").alias("total_unrealized_pnl"),
        round_to(money_avg("unrealized_pnl_ratio", 8), 6).alias("avg_pnl_ratio"))


def top_positions(positions: DataFrame, n: int = 5, on: dt.date | str | None = None,
                  user_id: str | None = None) -> DataFrame:
    """Largest holdings per user by market value."""
    held = position_book(positions, on, user_id).filter(F.col("position_quantity") > 0)
    return latest_rows(held, "user_id", "market_value", n, tie_break=["stock_code"]).select(
        "user_id", "position_date", "stock_code", "position_quantity", "market_value",
        "unrealized_pnl", "unrealized_pnl_ratio")


def position_history(positions: DataFrame, user_id: str | None = None,
                     start=None, end=None) -> DataFrame:
    rows = date_between(positions, "position_date", start, end)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("position_date").alias("total_days"),
        F.count_distinct("stock_code").alias("total_stocks"),
        F.min("position_date").alias("earliest_date"),
        F.max("position_date").alias("latest_date"))


def with_marks(positions: DataFrame) -> DataFrame:
    """Adds the price implied by each holding's value, its gain and gain ratio."""
    qty = F.col("position_quantity").cast("double")
    price = tf.mark_price(qty, F.col("market_value"))
    gain = tf.unrealized_pnl(qty, F.col("open_price"), F.col("market_value"), F.col("current_price"))
    return (positions.withColumn("current_price", price)
            .withColumn("unrealized_pnl", gain)
            .withColumn("unrealized_pnl_ratio",
                        tf.pnl_ratio(F.col("unrealized_pnl"), qty, F.col("open_price"))))


def revalue(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Holdings at given prices (``code, price``); zeros without price or quantity."""
    marks = prices.select(F.col("code").alias("_code"), F.col("price").alias("_price"))
    joined = positions.join(marks, F.col("stock_code") == F.col("_code"), "left")
    qty = F.col("position_quantity").cast("double")
    price = F.coalesce(F.col("_price"), F.col("current_price"))
    usable = F.coalesce((price > 0) & (qty > 0), F.lit(False))
    cost = F.col("open_price") * qty
    out = joined.select(
        *[c for c in positions.columns
          if c not in ("current_price", "unrealized_pnl", "unrealized_pnl_ratio")],
        price.alias("current_price"),
        F.when(usable, price * qty).otherwise(0.0).alias("current_market_value"),
        F.when(usable, price * qty - cost).otherwise(0.0).alias("unrealized_pnl"),
        cost.alias("_cost"), usable.alias("_usable"))
    gain = F.when(F.col("_usable") & (F.col("_cost") > 0),
                  F.try_divide(F.col("unrealized_pnl"), F.col("_cost"))).otherwise(0.0)
    return out.withColumn("unrealized_pnl_ratio", gain).drop("_cost", "_usable")


def snapshot_gaps(positions: DataFrame, max_gap: int = 7) -> DataFrame:
    """Consecutive snapshot dates of a user more than ``max_gap`` days apart.

    Dates are made distinct first, so a user's group is bounded by the calendar.
    """
    dates = positions.select("user_id", "position_date").distinct()
    before = F.lag("position_date").over(Window.partitionBy("user_id").orderBy("position_date"))
    return (dates.withColumn("prev_date", before)
            .withColumn("gap_days", F.datediff("position_date", "prev_date"))
            .filter(F.col("gap_days") > max_gap))


def snapshot_gap_counts(positions: DataFrame, max_gap: int = 7) -> DataFrame:
    return snapshot_gaps(positions, max_gap).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("gap_count"))


def running_positions(ledger: DataFrame, *extra: Column) -> DataFrame:
    """End-of-day holding per user and stock, from the ledger (days with trades only).

    ``extra`` are further aggregates over the same user, stock and day. Trades are dealt by user and stock at once: both the
    day's sums and the running one are formed there, and nothing is shuffled a second time. The parts are as many as a
    shuffle has, never merged into larger ones: a task holds the sums and the sorted days of its part at once.
    """
    parts = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ledger.repartition(parts, "user_id", "stock_code")
    daily = dealt.groupBy("user_id", "stock_code", F.col("trade_date").alias("position_date")).agg(
        F.sum(signed("quantity").cast("decimal(38,10)")).alias("_q"), *extra)
    upto = Window.partitionBy("user_id", "stock_code").orderBy("position_date")
    return daily.withColumn("position_quantity", F.sum("_q").over(upto).cast("double")).drop("_q")


def account_position_check(accounts: DataFrame, positions: DataFrame,
                           tolerance: float = 10.0) -> DataFrame:
    """Accounts whose market value is not the sum of that day's holdings."""
    held = positions.groupBy("user_id", F.col("position_date").alias("info_date")).agg(
        money_sum("market_value").alias("holdings_value"))
    joined = accounts.join(held, ["user_id", "info_date"], "left")
    diff = F.abs(F.col("position_market_value") - F.coalesce("holdings_value", F.lit(0.0)))
    return joined.withColumn("diff", diff).filter(F.col("diff") > tolerance).select(
        "user_id", "info_date", "position_market_value", "holdings_value", "diff")


# --- row validity -----------------------------------------------------------

def _filled(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & (F.col(n).cast("string") != "")
    return out


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def trade_is_valid() -> Column:
    return _flag(
        _filled("trade_id", "user_id", "stock_code", "trade_date", "trade_time")
        & F.col("trade_type").isin(BUY, SELL) & present("quantity", "price")
        & ~not_positive("quantity", "price")
        & has_known_suffix("stock_code") & (F.to_date("trade_time") == F.col("trade_date")))


def position_is_valid() -> Column:
    return _flag(
        _filled("position_id", "user_id", "stock_code", "position_date")
        & present(*HOLDING, "open_price", "market_value") & ~holding_clash()
        & has_known_suffix("stock_code") & ~below_zero("open_price", "market_value")
        & ~F.coalesce(below_zero("current_price"), F.lit(False)))


def account_is_valid() -> Column:
    money = ("total_assets", *CASH)
    return _flag(_filled("user_id", "info_date") & present(*money) & ~below_zero(*money))


def account_imbalance() -> Column:
    return gap("total_assets", *CASH)


def account_warns(limit: float = 10.0) -> Column:
    """Parts do not add up; a warning, the row stays valid."""
    return _flag(account_imbalance() > limit)


def security_is_valid() -> Column:
    return _flag(_filled("code", "display_name", "start_date")
                 & has_known_suffix("code", vendor_forms=True)
                 & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("start_date"))))


def statement_is_valid() -> Column:
    return _flag(_filled("code") & F.col("stat_date").isNotNull())


VALIDITY = {
    "stock_list": security_is_valid,
    "user_transactions": trade_is_valid,
    "user_positions": position_is_valid,
    "user_account_info": account_is_valid,
    "income_statement": statement_is_valid,
    "cashflow_statement": statement_is_valid,
    "balance_sheet": statement_is_valid,
}


def with_validity(df: DataFrame, table: str) -> DataFrame:
    out = df.withColumn("is_valid", VALIDITY[table]())
    if table == "user_account_info":
        out = out.withColumn("imbalance_warning", account_warns())
    return out


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects."""
    flagged = with_validity(df, table)
    return (flagged.filter("is_valid").drop("is_valid", "imbalance_warning"),
            flagged.filter("NOT is_valid").drop("is_valid", "imbalance_warning"))
