"""Range reads, batches, filters, pages, searches and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import codes as cf
from quotemill.functions import dates as df_
from quotemill.operators import coverage, ledger, scan
from quotemill.plans.market import EVENTS_AS_OF, LEDGER_AS_OF, Market
from quotemill.plans.registry import query

_CODES = ["000007.SZ", "000012.SH", "000050.BJ"]
_IN = "('000007.SZ', '000012.SH', '000050.BJ')"


@query("range_scan_prices", "bars_ev", sql="""
    SELECT code, day AS date, open, close FROM bars_ev
    WHERE code = '000007.SZ' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def range_scan_prices(m: Market):
    return scan.range_scan(m.bars_ev, "000007.SZ", "2024-01-05", "2024-01-25",
                           fields=["open", "close"], rename={"day": "date"})


@query("range_scan_statements", "statements", sql="""
    SELECT code, pub_date, stat_date, report_type, total_operating_revenue FROM statements
    WHERE pub_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def range_scan_statements(m: Market):
    return scan.range_scan(m.statements, None, "1997-01-01", "1998-12-31", date_col="pub_date",
                           fields=["stat_date", "report_type", "total_operating_revenue"])


@query("batch_scan_prices", "bars_li", sql=f"""
    SELECT code, day, open, high, low, close, volume FROM bars_li
    WHERE code IN {_IN} AND day >= DATE '1996-01-01'""")
def batch_scan_prices(m: Market):
    return scan.batch_scan(m.bars_li, _CODES, "1996-01-01",
                           fields=["open", "high", "low", "close", "volume"])


@query("batch_scan_by_code_table", "valuation", "securities", sql="""
    SELECT code, day, market_cap, pe_ratio FROM valuation
    WHERE code IN (SELECT code FROM securities WHERE security_type = 'stock' AND status = 'normal')""")
def batch_scan_by_code_table(m: Market):
    wanted = m.securities.filter("security_type = 'stock' AND status = 'normal'").select("code")
    return scan.batch_scan(m.valuation, wanted, fields=["market_cap", "pe_ratio"])


@query("batch_scan_indicators", "indicators", sql=f"""
    SELECT code, "pubDate", "statDate", eps, roe FROM indicators
    WHERE code IN {_IN} AND "pubDate" >= DATE '1998-01-01'""")
def batch_scan_indicators(m: Market):
    return scan.batch_scan(m.indicators, _CODES, "1998-01-01", date_col="pubDate",
                           fields=["statDate", "eps", "roe"])


@query("transactions_filtered", "ledger", sql="""
    SELECT trade_id, user_id, stock_code, trade_date, trade_type, quantity FROM ledger
    WHERE trade_type = 24 AND strategy_id = 'str3'
      AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def transactions_filtered(m: Market):
    return scan.transactions(m.ledger, trade_type=24, strategy_id="str3", start="1996-01-01",
                             end="1999-12-31").select(
        "trade_id", "user_id", "stock_code", "trade_date", "trade_type", "quantity")


@query("transactions_by_user", "ledger", sql="""
    SELECT trade_id, stock_code, trade_date, quantity FROM ledger WHERE user_id = '370'""")
def transactions_by_user(m: Market):
    return scan.transactions(m.ledger, user_id="370").select(
        "trade_id", "stock_code", "trade_date", "quantity")


@query("transactions_by_stock", "ledger", sql="""
    SELECT trade_id, user_id, trade_date, quantity FROM ledger WHERE stock_code = '000012.SH'""")
def transactions_by_stock(m: Market):
    return scan.transactions(m.ledger, stock_code="000012.SH").select(
        "trade_id", "user_id", "trade_date", "quantity")


@query("transactions_on_date", "ledger", sql="""
    SELECT trade_id, user_id, stock_code, quantity FROM ledger
    WHERE trade_date = DATE '1998-03-10'""")
def transactions_on_date(m: Market):
    return scan.transactions(m.ledger, trade_date=df_.day("1998-03-10")).select(
        "trade_id", "user_id", "stock_code", "quantity")


@query("transactions_recent_90d", "ledger", sql="""
    SELECT trade_id, user_id, stock_code, trade_date FROM ledger
    WHERE trade_date BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01'""")
def transactions_recent_90d(m: Market):
    return scan.recent(m.ledger, "2001-08-01", 90).select(
        "trade_id", "user_id", "stock_code", "trade_date")


@query("positions_filtered", "positions", sql="""
    SELECT position_id, position_quantity, market_value FROM positions
    WHERE stock_code = '000050.BJ' AND position_date >= DATE '1999-01-01'""")
def positions_filtered(m: Market):
    return scan.positions(m.positions, stock_code="000050.BJ", start="1999-01-01").select(
        "position_id", "position_quantity", "market_value")


@query("accounts_filtered", "accounts", sql="""
    SELECT * FROM accounts WHERE info_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""")
def accounts_filtered(m: Market):
    return scan.accounts(m.accounts, start="1998-01-01", end="1998-06-30")


@query("active_securities", "securities", sql="""
    SELECT code, display_name, exchange, market FROM securities
    WHERE (end_date IS NULL OR end_date > DATE '2000-06-29') AND start_date <= DATE '2000-06-29'
      AND exchange = 'XSHE'""")
def active_securities(m: Market):
    return scan.active_securities(m.securities, "2000-06-29", listed_by=True, exchange="XSHE") \
        .select("code", "display_name", "exchange", "market")


@query("normal_securities", "securities", sql="""
    SELECT code, market, status, end_date FROM securities
    WHERE status = 'normal' AND end_date IS NULL AND market = 'main'""")
def normal_securities(m: Market):
    return scan.normal_securities(m.securities, market="main").select(
        "code", "market", "status", "end_date")


@query("active_indices", "securities", sql="""
    SELECT code, security_type FROM securities
    WHERE status = 'normal' AND end_date IS NULL AND security_type = 'index'""")
def active_indices(m: Market):
    return scan.active_indices(m.securities).select("code", "security_type")


@query("exchange_scope_sh_sz", "securities", sql="""
    SELECT code, exchange FROM securities WHERE code LIKE '%.SH' OR code LIKE '%.SZ'""")
def exchange_scope_sh_sz(m: Market):
    return scan.exchange_scope(m.securities, "sh_sz").select("code", "exchange")


@query("quarter_end_rows", sql="""
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem
    WHERE strftime(l_shipdate, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31')""")
def quarter_end_rows(m: Market):
    rows = m.raw("lineitem").select("l_orderkey", "l_linenumber",
                                    F.to_date("l_shipdate").alias("day"))
    return scan.quarter_ends(rows, "day")


@query("missing_factors", "bars_ev", sql="""
    SELECT code, count(*) AS n_missing, min(day) AS first_day, max(day) AS last_day
    FROM (SELECT code, day, CASE WHEN day(day) % 3 <> 0 THEN factor END AS factor FROM bars_ev) x
    WHERE code LIKE '%.BJ' AND factor IS NULL GROUP BY code""")
def missing_factors(m: Market):
    bars = m.bars_ev.withColumn("factor", F.when(F.day("day") % 3 != 0, F.col("factor"))) \
        .withColumn("adj_factor", F.col("factor"))
    return scan.missing_factor_counts(bars)


@query("security_lookup", "securities", sql="""
    SELECT * FROM securities WHERE code = '000012.SH'""")
def security_lookup(m: Market):
    return coverage.security_info(m.securities, ["000012.SH"])


@query("security_info_batch", "securities", "ledger", sql="""
    SELECT * FROM securities WHERE code IN (SELECT stock_code FROM ledger WHERE trade_type = 24)""")
def security_info_batch(m: Market):
    sold = m.ledger.filter("trade_type = 24").select("stock_code").distinct()
    return coverage.security_info(m.securities, sold)


@query("newest_bundle_counts", "bars_li", "statements", "valuation", sql=f"""
    SELECT 'price_data' AS table_name, code, count(*) AS n FROM
      (SELECT code, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS rn FROM bars_li) a
      WHERE rn <= 10 AND code IN {_IN} GROUP BY code
    UNION ALL
    SELECT 'valuation_data', code, count(*) FROM
      (SELECT code, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS rn FROM valuation) b
      WHERE rn <= 10 AND code IN {_IN} GROUP BY code
    UNION ALL
    SELECT 'income_statement', code, count(*) FROM
      (SELECT code, row_number() OVER (PARTITION BY code ORDER BY pub_date DESC) AS rn
       FROM statements) c
      WHERE rn <= 10 AND code IN {_IN} GROUP BY code""")
def newest_bundle_counts(m: Market):
    tables = {"price_data": m.bars_li, "valuation_data": m.valuation,
              "income_statement": m.statements}
    bundle = scan.newest_bundle(tables, _CODES, {"price_data": "day", "valuation_data": "day",
                                                 "income_statement": "pub_date"})
    parts = [coverage.count_by(df, "code").select(F.lit(name).alias("table_name"), "code", "n")
             for name, df in bundle.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("fixed_projection", "bars_li", sql="""
    SELECT code, day AS trade_date, open, high, low, close FROM bars_li""")
def fixed_projection(m: Market):
    return scan.choose_fields(m.bars_li, ["code", "day"], ["open", "high", "low", "close"],
                              {"day": "trade_date"})


@query("last_n_rows", "bars_li", sql="""
    SELECT code, day, close FROM bars_li ORDER BY day DESC, code DESC LIMIT 25""")
def last_n_rows(m: Market):
    return scan.top(m.bars_li.select("code", "day", "close"), 25, "-day", "-code")


@query("page_behind_a_code", "securities", sql="""
    SELECT code, display_name FROM securities
    WHERE code > (SELECT max(code) FROM (SELECT code FROM securities ORDER BY code LIMIT 7) x) ORDER BY code LIMIT 20""")
def page_behind_a_code(m: Market):
    """The second page, found by the last code of the first."""
    rows = m.securities.select("code", "display_name")
    last = scan.page_after(rows, "code", None, 7).agg(F.max("code")).first()[0]
    return scan.page_after(rows, "code", last, 20)


@query("page_of_securities", "securities", sql="""
    SELECT code, display_name, end_date FROM securities
    ORDER BY end_date ASC NULLS LAST, code ASC LIMIT 20 OFFSET 20""")
def page_of_securities(m: Market):
    return scan.page(m.securities.select("code", "display_name", "end_date"), 20, 20,
                     "end_date", "code")


@query("page_total", "ledger", sql="SELECT count(*) AS total FROM ledger WHERE trade_type = 23")
def page_total(m: Market):
    return scan.page_total(scan.transactions(m.ledger, trade_type=23))


@query("sorted_indicators", "indicators", sql="""
    SELECT code, "statDate", eps FROM indicators ORDER BY eps DESC NULLS LAST, code, "statDate" """)
def sorted_indicators(m: Market):
    return scan.sorted_by(m.indicators.select("code", "statDate", "eps"), "-eps", "code", "statDate")


@query("search_securities", "securities", sql="""
    SELECT code, display_name FROM securities
    WHERE (code LIKE '%02%' OR display_name LIKE '%02%' OR name LIKE '%02%')
      AND status = 'normal' AND end_date IS NULL
    ORDER BY CASE WHEN code = '02' THEN 1 WHEN code LIKE '02%' THEN 2
                  WHEN display_name LIKE '02%' THEN 3 ELSE 4 END, code LIMIT 50""")
def search_securities(m: Market):
    return scan.search(m.securities, "02").select("code", "display_name")


@query("sample_securities", "securities", sql="""
    SELECT code, start_date FROM securities ORDER BY md5(code || '42'), code LIMIT 30""")
def sample_securities(m: Market):
    return scan.sample_rows(m.securities.select("code", "start_date"), 30, "code", "42")


@query("sample_trading_days", "bars_li", sql="""
    SELECT day FROM (SELECT DISTINCT day FROM bars_li) x
    ORDER BY md5(CAST(day AS VARCHAR) || '7'), day LIMIT 30""")
def sample_trading_days(m: Market):
    return scan.sample_rows(m.bars_li.select("day").distinct(), 30, "day", "7")


@query("union_of_feeds", "bars_ev", "bars_li", sql="""
    SELECT code, day, close, volume, money FROM bars_ev
    UNION ALL SELECT code, day, close, volume, NULL FROM bars_li""")
def union_of_feeds(m: Market):
    a = m.bars_ev.select("code", "day", "close", "volume", "money")
    b = m.bars_li.select("code", "day", "close", "volume")
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_markets", "securities", sql="SELECT DISTINCT exchange, market FROM securities")
def distinct_markets(m: Market):
    return m.securities.select("exchange", "market").distinct()


@query("code_dialects", "securities", sql="""
    SELECT code, replace(replace(replace(code, '.SZ', '.XSHE'), '.SH', '.XSHG'), '.BJ', '.BSE') AS vendor,
           code AS back, exchange,
           CASE exchange WHEN 'XSHG' THEN '上海证券交易所' WHEN 'XSHE' THEN '深圳证券交易所'
                ELSE '北京证券交易所' END AS exchange_name,
           CASE market WHEN 'main' THEN '主板' WHEN 'bse' THEN '北交所' WHEN 'gem' THEN '创业板'
                WHEN 'star' THEN '科创板' END AS market_name,
           status = 'normal' AND end_date IS NULL AS active, security_type = 'index' AS idx,
           CASE WHEN code LIKE '%.BJ' THEN 'secondary' ELSE 'primary' END AS feed
    FROM securities""")
def code_dialects(m: Market):
    return m.securities.select(
        "code", cf.vendor_code("code").alias("vendor"),
        cf.standard_code(cf.vendor_code("code")).alias("back"), "exchange",
        cf.exchange_name("exchange").alias("exchange_name"),
        cf.market_name("market").alias("market_name"), cf.is_active().alias("active"),
        cf.is_index().alias("idx"), cf.preferred_feed("code").alias("feed"))


@query("bare_code_forms", sql="""
    SELECT user_id, bare, CASE WHEN length(bare) = 4 THEN bare || '.BJ'
             WHEN left(bare, 2) IN ('60', '68', '90') THEN bare || '.SH'
             WHEN left(bare, 2) IN ('00', '30', '20') THEN bare || '.SZ' ELSE bare END AS code
    FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN lpad(CAST(user_id AS VARCHAR), 4, '8')
                 ELSE rpad(CAST(600000 + user_id * 3000 AS VARCHAR), 6, '0') END AS bare FROM events) x""")
def bare_code_forms(m: Market):
    u = F.col("user_id")
    bare = F.when(u % 4 == 0, F.lpad(u.cast("string"), 4, "8")).otherwise(
        F.rpad((u * 3000 + 600000).cast("string"), 6, "0"))
    rows = m.raw("events").select("user_id", bare.alias("bare")).distinct()
    return rows.withColumn("code", cf.standard_code("bare"))


@query("report_quarters_due", sql="""
    SELECT day, CASE WHEN month(day) <= 3 THEN make_date(year(day) - 1, 12, 31)
                     WHEN month(day) <= 4 THEN make_date(year(day), 3, 31)
                     WHEN month(day) <= 8 THEN make_date(year(day), 6, 30)
                     WHEN month(day) <= 10 THEN make_date(year(day), 9, 30)
                     ELSE make_date(year(day), 12, 31) END AS due,
           CAST(date_trunc('quarter', day) AS DATE) AS quarter_start,
           CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, strftime(day, '%Y%m%d') AS compact
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) x""")
def report_quarters_due(m: Market):
    days = m.raw("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select("day", df_.due_report_quarter("day").alias("due"),
                       df_.quarter_start("day").alias("quarter_start"),
                       df_.week_end("day").alias("week_end"), df_.compact_date("day").alias("compact"))


@query("lenient_dates", sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed,
           CASE WHEN hour(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) >= 15
                THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - 1 END AS closed_day
    FROM orders""")
def lenient_dates(m: Market):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd"))
            .when(k % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise(F.lit("n/a")))
    ts = F.timestamp_seconds(F.unix_timestamp(d) + (k % 24) * 3600)
    return m.raw("orders").select("o_orderkey", df_.parse_date(text).alias("parsed"),
                                  df_.last_closed_day(ts).alias("closed_day"))


@query("trade_labels", "ledger", sql="""
    SELECT trade_id, trade_type, CASE trade_type WHEN 23 THEN '买入' WHEN 24 THEN '卖出' ELSE '未知' END
           AS side, strategy_id, round(abs(quantity * price - amount) / nullif(amount, 0), 6) AS err
    FROM ledger""")
def trade_labels(m: Market):
    from quotemill.functions.values import relative_error, round_to

    err = relative_error(F.col("quantity") * F.col("price"), F.col("amount"))
    return m.ledger.select("trade_id", "trade_type", cf.trade_type_name("trade_type").alias("side"),
                           "strategy_id", round_to(err, 6).alias("err"))


@query("validity_flags", "positions", sql="""
    SELECT is_valid, count(*) AS n FROM (
      SELECT coalesce(position_quantity >= 0 AND available_quantity >= 0
               AND frozen_quantity <= position_quantity
               AND available_quantity + frozen_quantity <= position_quantity
               AND right(stock_code, 3) IN ('.SH', '.SZ', '.BJ') AND open_price >= 0
               AND market_value >= 0 AND (current_price IS NULL OR current_price >= 0), false)
             AS is_valid FROM positions) x GROUP BY is_valid""")
def validity_flags(m: Market):
    return coverage.count_by(ledger.with_validity(m.positions, "user_positions"), "is_valid")


@query("account_validity", "accounts", sql="""
    SELECT is_valid, imbalance_warning, count(*) AS n FROM (
      SELECT total_assets >= 0 AND position_market_value >= 0 AND available_cash >= 0
               AND frozen_cash >= 0 AS is_valid,
             abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10
               AS imbalance_warning FROM accounts) x GROUP BY 1, 2""")
def account_validity(m: Market):
    flagged = ledger.with_validity(m.accounts, "user_account_info")
    return coverage.count_by(flagged, "is_valid", "imbalance_warning")


@query("trade_validity", "ledger", sql="""
    SELECT CAST(year(trade_date) AS INTEGER) AS year, is_valid, count(*) AS n FROM (
      SELECT trade_date, trade_type IN (23, 24) AND quantity > 20 - 19.5::DOUBLE AND price > 0
               AND day(trade_date) % 9 <> 0 AS is_valid FROM ledger) x GROUP BY 1, 2""")
def trade_validity(m: Market):
    """Trades of every ninth day get a time on the wrong date, which makes them invalid."""
    shifted = F.when(F.day("trade_date") % 9 == 0, F.date_add("trade_date", 1)).otherwise(
        F.col("trade_date"))
    trades = m.ledger.withColumn("trade_time", df_.trade_timestamp(shifted, F.lit("09:30:00")))
    flagged = ledger.with_validity(trades, "user_transactions")
    return coverage.count_by(flagged, F.year("trade_date").alias("year"), "is_valid")
