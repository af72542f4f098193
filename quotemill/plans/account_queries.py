"""Ledger, holdings and account queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import trades as tf
from quotemill.operators import calendar as cal
from quotemill.operators import ledger, series
from quotemill.plans.market import Market, dsum, query_round
from quotemill.plans.registry import query

_SIGN_Q = "CASE WHEN trade_type = 23 THEN quantity ELSE -quantity END"
_SIGN_N = "CASE WHEN trade_type = 23 THEN net_amount ELSE -net_amount END"


@query("net_positions", "ledger", sql=f"""
    SELECT * FROM (SELECT user_id, stock_code, {dsum(_SIGN_Q)} AS total_quantity,
                          {dsum(_SIGN_N)} AS total_amount, count(*) AS transaction_count
                   FROM ledger GROUP BY user_id, stock_code) x WHERE total_quantity > 0""")
def net_positions(m: Market):
    return ledger.net_positions(m.ledger)


@query("net_positions_at_date", "ledger", sql=f"""
    SELECT * FROM (SELECT user_id, stock_code, {dsum(_SIGN_Q)} AS total_quantity,
                          {dsum(_SIGN_N)} AS total_amount, count(*) AS transaction_count
                   FROM ledger WHERE trade_date <= DATE '1998-12-31'
                   GROUP BY user_id, stock_code) x WHERE total_quantity > 0""")
def net_positions_at_date(m: Market):
    return ledger.net_positions(m.ledger, end="1998-12-31")


_SUMS = ", ".join(f"{dsum(c)} AS total_{c}" for c in
                  ("quantity", "amount", "commission", "stamp_tax", "other_fees", "net_amount"))


@query("daily_trade_summary", "ledger", sql=f"""
    SELECT trade_date, user_id, stock_code, trade_type, count(*) AS trade_count, {_SUMS},
           CASE trade_type WHEN 23 THEN '买入' WHEN 24 THEN '卖出' ELSE '未知' END AS trade_type_name
    FROM ledger GROUP BY trade_date, user_id, stock_code, trade_type""")
def daily_trade_summary(m: Market):
    return ledger.daily_summary(m.ledger)


@query("daily_trade_summary_on", "ledger", sql=f"""
    SELECT user_id, stock_code, trade_type, count(*) AS trade_count, {_SUMS},
           CASE trade_type WHEN 23 THEN '买入' WHEN 24 THEN '卖出' ELSE '未知' END AS trade_type_name
    FROM ledger WHERE trade_date = DATE '1998-03-10' GROUP BY user_id, stock_code, trade_type""")
def daily_trade_summary_on(m: Market):
    return ledger.daily_summary(m.ledger, "1998-03-10")


@query("user_stock_summary", "ledger", sql=f"""
    SELECT user_id, stock_code, count(*) AS trade_count,
           {dsum('CASE WHEN trade_type = 23 THEN quantity ELSE 0 END')} AS buy_quantity,
           {dsum('CASE WHEN trade_type = 24 THEN quantity ELSE 0 END')} AS sell_quantity,
           {dsum('CASE WHEN trade_type = 23 THEN amount ELSE 0 END')} AS buy_amount,
           {dsum('CASE WHEN trade_type = 24 THEN amount ELSE 0 END')} AS sell_amount,
           {dsum('commission + stamp_tax + other_fees')} AS total_fees,
           min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date
    FROM ledger GROUP BY user_id, stock_code""")
def user_stock_summary(m: Market):
    return ledger.user_summary(m.ledger)


@query("ledger_totals", "ledger", sql="""
    SELECT count(*) AS total_trades, count(DISTINCT user_id) AS n_users,
           count(DISTINCT stock_code) AS n_stocks, min(trade_date) AS first_date,
           max(trade_date) AS last_date, count(*) FILTER (trade_type = 23) AS n_buys,
           count(*) FILTER (trade_type = 24) AS n_sells FROM ledger""")
def ledger_totals(m: Market):
    return ledger.ledger_totals(m.ledger)


_BOOK = """
    SELECT p.* FROM positions p JOIN (SELECT user_id AS u, max(position_date) AS d FROM positions
                                      GROUP BY user_id) x ON p.user_id = x.u AND p.position_date = x.d
    WHERE position_quantity > 0"""


@query("position_summary_latest", "positions", sql=f"""
    SELECT user_id, position_date, count(*) AS total_positions,
           count(DISTINCT stock_code) AS unique_stocks,
           CAST(sum(position_quantity) AS BIGINT) AS total_quantity,
           {dsum('market_value')} AS total_market_value,
           {dsum('unrealized_pnl')} AS total_unrealized_pnl,
           round({dsum('round(unrealized_pnl_ratio, 6)', 8)} / count(unrealized_pnl_ratio), 6)
               AS avg_pnl_ratio
    FROM ({_BOOK}) b GROUP BY user_id, position_date""")
def position_summary_latest(m: Market):
    return ledger.position_summary(query_round(m.positions, "unrealized_pnl_ratio"))


@query("position_summary_on", "positions", sql=f"""
    SELECT user_id, position_date, count(*) AS total_positions,
           count(DISTINCT stock_code) AS unique_stocks,
           CAST(sum(position_quantity) AS BIGINT) AS total_quantity,
           {dsum('market_value')} AS total_market_value,
           {dsum('unrealized_pnl')} AS total_unrealized_pnl,
           round({dsum('round(unrealized_pnl_ratio, 6)', 8)} / count(unrealized_pnl_ratio), 6)
               AS avg_pnl_ratio
    FROM positions WHERE position_date = DATE '1998-03-10' AND position_quantity > 0
    GROUP BY user_id, position_date""")
def position_summary_on(m: Market):
    return ledger.position_summary(query_round(m.positions, "unrealized_pnl_ratio"), "1998-03-10")


@query("top_positions", "positions", sql=f"""
    SELECT user_id, position_date, stock_code, position_quantity, market_value, unrealized_pnl,
           round(unrealized_pnl_ratio, 6) AS unrealized_pnl_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                      ORDER BY market_value DESC, stock_code DESC) AS n FROM ({_BOOK}) b) x
    WHERE n <= 5""")
def top_positions(m: Market):
    return query_round(ledger.top_positions(m.positions), "unrealized_pnl_ratio")


@query("position_history", "positions", sql="""
    SELECT user_id, count(*) AS total_records, count(DISTINCT position_date) AS total_days,
           count(DISTINCT stock_code) AS total_stocks, min(position_date) AS earliest_date,
           max(position_date) AS latest_date FROM positions GROUP BY user_id""")
def position_history(m: Market):
    return ledger.position_history(m.positions)


@query("running_positions", "ledger", sql=f"""
    SELECT user_id, stock_code, position_date,
           CAST(sum(q) OVER (PARTITION BY user_id, stock_code ORDER BY position_date) AS DOUBLE)
               AS position_quantity
    FROM (SELECT user_id, stock_code, trade_date AS position_date,
                 sum(CAST({_SIGN_Q} AS DECIMAL(38,10))) AS q
          FROM ledger GROUP BY user_id, stock_code, trade_date) x""")
def running_positions(m: Market):
    return ledger.running_positions(m.ledger)


@query("account_history", "accounts", sql="SELECT * FROM accounts")
def account_history(m: Market):
    return m.accounts


@query("position_marks", "positions", sql="""
    SELECT position_id, round(px, 6) AS current_price,
           round(CASE WHEN px > 0 AND open_price > 0
                      THEN market_value - open_price * position_quantity END, 4) AS unrealized_pnl
    FROM (SELECT *, CASE WHEN position_quantity > 0 AND market_value > 0
                         THEN market_value / position_quantity END AS px FROM positions) x""")
def position_marks(m: Market):
    from quotemill.functions.values import round_to

    marked = ledger.with_marks(m.positions)
    return marked.select("position_id", round_to("current_price", 6).alias("current_price"),
                         round_to("unrealized_pnl", 4).alias("unrealized_pnl"))


@query("positions_revalued", "positions", "bars_li", sql="""
    SELECT position_id, round(px, 6) AS current_price,
           round(CASE WHEN ok THEN px * position_quantity ELSE 0.0 END, 4) AS current_market_value,
           round(CASE WHEN ok THEN px * position_quantity - cost ELSE 0.0 END, 4) AS unrealized_pnl,
           round(CASE WHEN ok AND cost > 0 THEN (px * position_quantity - cost) / cost ELSE 0.0 END, 6)
               AS unrealized_pnl_ratio
    FROM (SELECT position_id, position_quantity, px, open_price * position_quantity AS cost,
                 px > 0 AND position_quantity > 0 AS ok
          FROM (SELECT p.*, coalesce(l.close, p.current_price) AS px
                FROM positions p LEFT JOIN (SELECT code, max_by(close, day) AS close FROM bars_li
                                            GROUP BY code) l ON p.stock_code = l.code) a) b""")
def positions_revalued(m: Market):
    from quotemill.functions.values import round_to

    marks = series.latest_rows(m.bars_li).select("code", F.col("close").alias("price"))
    out = ledger.revalue(m.positions, marks)
    return out.select("position_id", round_to("current_price", 6).alias("current_price"),
                      round_to("current_market_value", 4).alias("current_market_value"),
                      round_to("unrealized_pnl", 4).alias("unrealized_pnl"),
                      round_to("unrealized_pnl_ratio", 6).alias("unrealized_pnl_ratio"))


@query("snapshot_gaps", "positions", sql="""
    SELECT user_id, position_date, prev_date,
           CAST(date_diff('day', prev_date, position_date) AS INTEGER) AS gap_days
    FROM (SELECT user_id, position_date,
                 lag(position_date) OVER (PARTITION BY user_id ORDER BY position_date) AS prev_date
          FROM (SELECT DISTINCT user_id, position_date FROM positions) x) y
    WHERE date_diff('day', prev_date, position_date) > 7""")
def snapshot_gaps(m: Market):
    return ledger.snapshot_gaps(m.positions)


@query("snapshot_gap_counts", "positions", sql="""
    SELECT user_id, count(*) AS gap_count
    FROM (SELECT user_id, position_date,
                 lag(position_date) OVER (PARTITION BY user_id ORDER BY position_date) AS prev_date
          FROM (SELECT DISTINCT user_id, position_date FROM positions) x) y
    WHERE date_diff('day', prev_date, position_date) > 7 GROUP BY user_id""")
def snapshot_gap_counts(m: Market):
    return ledger.snapshot_gap_counts(m.positions)


@query("account_position_check", "accounts", "positions", sql=f"""
    SELECT user_id, info_date, position_market_value, holdings_value,
           round(abs(position_market_value - coalesce(holdings_value, 0)), 4) AS diff
    FROM (SELECT a.user_id, a.info_date, h.holdings_value,
                 a.position_market_value + CASE WHEN day(a.info_date) = 1 THEN 12.5 ELSE 0 END
                     AS position_market_value
          FROM accounts a LEFT JOIN (SELECT user_id, position_date, {dsum('market_value')}
                                            AS holdings_value
                                     FROM positions GROUP BY 1, 2) h
            ON a.user_id = h.user_id AND a.info_date = h.position_date) x
    WHERE abs(position_market_value - coalesce(holdings_value, 0)) > 10""")
def account_position_check(m: Market):
    """First-of-month accounts are shifted by 12.5, so there is something to find."""
    from quotemill.functions.values import round_to

    shifted = m.accounts.withColumn(
        "position_market_value", F.col("position_market_value")
        + F.when(F.day("info_date") == 1, 12.5).otherwise(0.0))
    out = ledger.account_position_check(shifted, m.positions)
    return out.withColumn("diff", round_to("diff", 4))


@query("off_calendar_trades", "ledger", sql="""
    SELECT trade_id, user_id, trade_date FROM ledger
    WHERE trade_date >= DATE '1996-01-01'
      AND trade_date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem
                             WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)""")
def off_calendar_trades(m: Market):
    return cal.off_calendar(m.ledger, _weekdays(m), "trade_date", "1996-01-01").select(
        "trade_id", "user_id", "trade_date")


def _weekdays(m: Market):
    ships = m.raw("lineitem").select(F.to_date("l_shipdate").alias("day"))
    return cal.trading_calendar(ships.filter(F.dayofweek("day").between(2, 6)))


_OPEN = """(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem
            WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)"""


@query("off_calendar_positions", "positions", sql=f"""
    SELECT position_id, position_date FROM positions
    WHERE position_date >= DATE '1996-01-01' AND position_date NOT IN (SELECT day FROM {_OPEN} c)""")
def off_calendar_positions(m: Market):
    return cal.off_calendar(m.positions, _weekdays(m), "position_date", "1996-01-01").select(
        "position_id", "position_date")


@query("off_calendar_accounts", "accounts", sql=f"""
    SELECT user_id, info_date FROM accounts
    WHERE info_date >= DATE '1996-01-01' AND info_date NOT IN (SELECT day FROM {_OPEN} c)""")
def off_calendar_accounts(m: Market):
    return cal.off_calendar(m.accounts, _weekdays(m), "info_date", "1996-01-01").select(
        "user_id", "info_date")


@query("missing_position_days", "positions", sql=f"""
    SELECT day FROM {_OPEN} c
    WHERE day >= DATE '1995-06-01' AND day <= (SELECT max(position_date) FROM positions)
      AND day NOT IN (SELECT position_date FROM positions WHERE stock_code LIKE '%7.SZ')""")
def missing_position_days(m: Market):
    """Snapshots of one family of codes, so that some trading days lack them."""
    some = m.positions.filter(F.col("stock_code").endswith("7.SZ"))
    last = m.positions.agg(F.max("position_date").alias("position_date"))
    marked = some.select("position_date").unionByName(last)
    gaps = cal.missing_snapshot_days(marked, _weekdays(m), "position_date", "1995-06-01")
    held = last.join(some.select("position_date"), "position_date", "left_anti")
    open_last = cal.on_calendar(held.withColumnRenamed("position_date", "day"), _weekdays(m), "day")
    return gaps.unionByName(open_last.select("day"))


@query("missing_account_days", "accounts", sql=f"""
    SELECT day FROM {_OPEN} c
    WHERE day >= DATE '1995-06-01' AND day <= (SELECT max(info_date) FROM accounts)
      AND day NOT IN (SELECT info_date FROM accounts)""")
def missing_account_days(m: Market):
    return cal.missing_snapshot_days(m.accounts, _weekdays(m), "info_date", "1995-06-01")


@query("net_amount_rule", "ledger", sql="""
    SELECT trade_id, trade_type, amount, net_amount FROM ledger""")
def net_amount_rule(m: Market):
    return m.ledger.select("trade_id", "trade_type", "amount",
                           tf.net_amount("trade_type", "amount", "commission", "stamp_tax",
                                         "other_fees").alias("net_amount"))
