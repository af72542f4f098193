"""Landed feeds, keyed writes and incremental loads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quotemill.functions import trades as tf
from quotemill.operators import calendar as cal
from quotemill.operators import coverage as cov
from quotemill.operators import kept_states, merge
from quotemill.plans.market import EVENTS_AS_OF, LEDGER_AS_OF, Market, dsum
from quotemill.plans.registry import query
from quotemill.schemas import SCHEMAS
from quotemill.session import shared_dir
from quotemill.sources import landed, tables

_PRICE_COLUMNS = [f.name for f in SCHEMAS["price_data"].fields]
_TYPES = {"paused": "INTEGER", "code": "VARCHAR", "day": "DATE"}


def _nulls(have: dict[str, str]) -> str:
    return ", ".join(f"{have[c]} AS {c}" if c in have
                     else f"CAST(NULL AS {_TYPES.get(c, 'DOUBLE')}) AS {c}" for c in _PRICE_COLUMNS)


_FEED = {"code": "ts_code", "day": "CAST(strptime(trade_date, '%Y%m%d') AS DATE)", "open": "open",
         "close": "close", "high": "high", "low": "low", "volume": "vol", "money": "amount"}


@query("landed_price_feed", "vendor_prices", sql=f"SELECT {_nulls(_FEED)} FROM vendor_prices")
def landed_price_feed(m: Market):
    return landed.price_feed(m.vendor_prices)


@query("landed_pre_adjusted_prices", "bars_ev", sql="SELECT " + _nulls({
    "code": "code", "day": "day", "open": "open", "close": "close", "high": "high", "low": "low",
    "volume": "volume", "money": "money", "factor": "factor", "adj_factor": "factor",
    "adj_close": "close", "paused": "0"}) + " FROM bars_ev")
def landed_pre_adjusted_prices(m: Market):
    return landed.price_feed(m.bars_ev, pre_adjusted=True)


@query("landed_daily_basic", "vendor_prices", sql="""
    SELECT code, day, close, turnover_rate FROM (
      SELECT ts_code AS code, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS day, close,
             vol AS turnover_rate FROM vendor_prices) x""")
def landed_daily_basic(m: Market):
    raw = m.vendor_prices.select("ts_code", "trade_date", "close", F.col("vol").alias("turnover_rate"))
    return landed.daily_basic_feed(raw).select("code", "day", "close", "turnover_rate")


@query("landed_statements", "statements", sql="""
    SELECT code, stat_date, pub_date, net_profit FROM statements""")
def landed_statements(m: Market):
    """Statements with vendor codes, text dates in mixed forms and no stat_date column."""
    from quotemill.functions.codes import vendor_code

    form = F.when(F.month("stat_date") == 3, F.date_format("stat_date", "yyyyMMdd")).otherwise(
        F.col("stat_date").cast("string"))
    raw = m.statements.select(vendor_code("code").alias("code"), form.alias("report_date"),
                              F.col("pub_date").cast("string").alias("pubDate"), "net_profit")
    return landed.statement_feed(raw).select("code", "stat_date", "pub_date", "net_profit")


@query("landed_numbers", "indicators", sql="""
    SELECT code, "statDate", CASE WHEN month("statDate") <> 6 THEN eps END AS eps, roe FROM indicators""")
def landed_numbers(m: Market):
    """Ratios as text, every second quarter of a year not a number."""
    raw = m.indicators.select("code", "statDate", F.when(F.month("statDate") == 6, "n/a").otherwise(
        F.col("eps").cast("string")).alias("eps"), F.col("roe").cast("string").alias("roe"))
    return landed.numeric_feed(raw)


@query("security_master_build", "securities", sql="""
    SELECT code, display_name, start_date, end_date, exchange, market, security_type, status,
           display_name LIKE '%ST%' AS is_st, DATE '2001-11-01' AS update_date
    FROM (SELECT * REPLACE ('stock' AS security_type, 'normal' AS status) FROM securities
          WHERE security_type = 'stock'
          UNION ALL
          SELECT * REPLACE (CAST(NULL AS VARCHAR) AS market, 'normal' AS status, '' AS display_name)
          FROM securities WHERE security_type = 'index') x""")
def security_master_build(m: Market):
    """Stocks arrive as two listings with vendor codes, indices with far-future end dates."""
    from quotemill.functions.codes import vendor_code

    s = m.securities.withColumn("code", vendor_code("code"))
    stocks = s.filter("security_type = 'stock'").select("code", "display_name", "name", "start_date",
                                                        "end_date")
    indices = s.filter("security_type = 'index'").select(
        "code", F.lit("").alias("display_name"), "start_date",
        F.coalesce("end_date", F.to_date(F.lit("2200-01-01"))).alias("end_date"))
    made = landed.security_master(stocks.filter("code NOT LIKE '%.BSE'"),
                                  stocks.filter("code LIKE '%.BSE'").drop("name"), "2001-11-01")
    return made.unionByName(landed.index_master(indices, "2001-11-01")).select(
        "code", "display_name", "start_date", "end_date", "exchange", "market", "security_type",
        "status", "is_st", "update_date")


@query("align_to_price_schema", "bars_li", sql="SELECT " + _nulls({
    "code": "code", "day": "day", "open": "open", "close": "close", "high": "high", "low": "low",
    "volume": "volume"}) + " FROM bars_li")
def align_to_price_schema(m: Market):
    wild = m.bars_li.withColumn("surplus", F.lit(1)).withColumn("day", F.date_format("day", "yyyyMMdd"))
    return landed.align_to_schema(wild, "price_data")


@query("split_indicator_families", "indicators", sql="""
    SELECT 'profit' AS family, code, "statDate", roe AS value FROM indicators
    UNION ALL SELECT 'assets', code, "statDate", roa FROM indicators""")
def split_indicator_families(m: Market):
    parts = landed.split_columns(m.indicators, ["code", "statDate"],
                                 {"profit": ["roe", "eps"], "assets": ["roa"]})
    return parts["profit"].select(F.lit("profit").alias("family"), "code", "statDate",
                                  F.col("roe").alias("value")).unionAll(
        parts["assets"].select(F.lit("assets").alias("family"), "code", "statDate", "roa"))


@query("column_renames", "statements", sql="""
    SELECT code, pub_date, stat_date, total_liability AS estimate_liability,
           CAST(NULL AS DOUBLE) AS rd_expenses FROM statements""")
def column_renames(m: Market):
    old = m.statements.select("code", F.col("pub_date").alias("pubDate"),
                              F.col("stat_date").alias("statDate"),
                              F.col("total_liability").alias("estimated_liability"), "total_assets")
    from pyspark.sql import types as T

    add = T.StructType([T.StructField("rd_expenses", T.DoubleType())])
    return landed.conform_columns(landed.renamed(old, landed.CAMEL_RENAMES), add,
                                  drop=["total_assets"], rename=landed.LEGACY_BALANCE_RENAMES)


@query("adhoc_sql_with_parameters", "ledger", sql="""
    SELECT stock_code, count(*) AS n FROM ledger
    WHERE trade_type = 24 AND trade_date >= DATE '1998-01-01' GROUP BY stock_code""")
def adhoc_sql_with_parameters(m: Market):
    tables.register({"user_transactions": m.ledger})
    return tables.sql(m.spark, "SELECT stock_code, count(*) AS n FROM user_transactions "
                      "WHERE trade_type = ? AND trade_date >= ? GROUP BY stock_code",
                      [24, dt.date(1998, 1, 1)])


@query("views_stocks_and_indices", "securities", "statements", sql="""
    SELECT 'stocks' AS view_name, count(*) AS n FROM securities WHERE security_type = 'stock'
    UNION ALL SELECT 'indices', count(*) FROM securities WHERE security_type = 'index'
    UNION ALL SELECT 'income_statement_latest', count(*) FROM
      (SELECT DISTINCT code, stat_date FROM statements) x""")
def views_stocks_and_indices(m: Market):
    from quotemill.operators.scan import register_views

    names = register_views(m.securities, {"income_statement": m.statements})
    parts = [m.spark.table(n).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(n).alias("view_name"), "n") for n in names]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- keyed writes -----------------------------------------------------------

_LI_NEW = """(SELECT code, day, close * 2.0::DOUBLE AS close FROM bars_li WHERE day >= DATE '2001-01-01')"""
_LI_OLD = """(SELECT code, day, close FROM bars_li WHERE day <= DATE '2001-06-30')"""


def _old(m: Market):
    return m.bars_li.filter("day <= DATE '2001-06-30'").select("code", "day", "close")


def _new(m: Market):
    return m.bars_li.filter("day >= DATE '2001-01-01'").select(
        "code", "day", (F.col("close") * 2.0).alias("close"))


@query("insert_or_ignore", "bars_li", sql=f"""
    SELECT * FROM {_LI_OLD} o UNION ALL SELECT * FROM {_LI_NEW} n WHERE day > DATE '2001-06-30'""")
def insert_or_ignore(m: Market):
    return merge.insert_or_ignore(_old(m), _new(m), ["code", "day"])


@query("upsert", "bars_li", sql=f"""
    SELECT * FROM {_LI_OLD} o WHERE day < DATE '2001-01-01' UNION ALL SELECT * FROM {_LI_NEW} n""")
def upsert(m: Market):
    """The batch holds every key twice; the later version has the smaller close."""
    new = _new(m).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "close", F.col("close") + F.when(F.col("version") == 1, 1000.0).otherwise(0.0))
    old = _old(m).withColumn("version", F.lit(0))
    return merge.upsert(old, new, ["code", "day"], ["version"]).drop("version")


@query("first_of_batch_wins", "ledger", sql="""
    SELECT trade_id, user_id, stock_code, trade_date, quantity, amount FROM (
      SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY trade_date, user_id, stock_code,
                                   quantity, amount) AS n FROM ledger) x WHERE n = 1""")
def first_of_batch_wins(m: Market):
    batch = m.ledger.select("trade_id", "user_id", "stock_code", "trade_date", "quantity", "amount")
    return merge.one_per_key(batch, ["trade_id"], ["trade_date"])


@query("delete_by_conditions", "positions", sql="""
    SELECT position_id, user_id FROM positions
    WHERE NOT (user_id = '370' AND position_date = DATE '1998-03-10')""")
def delete_by_conditions(m: Market):
    kept = merge.delete_where(m.positions, user_id="370", position_date=dt.date(1998, 3, 10))
    return kept.select("position_id", "user_id")


@query("update_industry", "securities", sql="""
    SELECT code, CASE WHEN market = 'bse' THEN 'J66' END AS industry_code,
           CASE WHEN market = 'bse' THEN 'Finance' END AS industry_name FROM securities""")
def update_industry(m: Market):
    s = m.securities.withColumns({c: F.lit(None).cast("string")
                                  for c in ("industry_code", "industry_name")})
    out = merge.update_where(s, {"industry_code": "J66", "industry_name": "Finance"}, market="bse")
    return out.select("code", "industry_code", "industry_name")


@query("update_many_industries", "securities", sql="""
    SELECT code, CASE WHEN code LIKE '%3.%' THEN 'I' || split_part(code, '.', 1) ELSE 'none' END AS industry_code
    FROM securities""")
def update_many_industries(m: Market):
    s = m.securities.withColumn("industry_code", F.lit("none"))
    changes = m.securities.filter("code LIKE '%3.%'").select(
        "code", F.concat(F.lit("I"), F.substring_index("code", ".", 1)).alias("industry_code"))
    return merge.update_from(s, changes, ["code"]).select("code", "industry_code")


_IMP_OLD = "(SELECT DISTINCT trade_id FROM ledger WHERE trade_date < DATE '1999-01-01')"


@query("import_trades_report", "ledger", sql=f"""
    WITH batch AS (SELECT * FROM ledger WHERE trade_date >= DATE '1998-06-01'),
         fresh AS (SELECT trade_id, min(trade_date) AS trade_date FROM batch
                   WHERE trade_id NOT IN (SELECT trade_id FROM {_IMP_OLD} k) GROUP BY trade_id),
         dups AS (SELECT trade_date FROM batch WHERE trade_id IN (SELECT trade_id FROM {_IMP_OLD} k))
    SELECT trade_date, CAST(sum(a) AS BIGINT) AS accepted, CAST(sum(d) AS BIGINT) AS duplicates
    FROM (SELECT trade_date, 1 AS a, 0 AS d FROM fresh UNION ALL SELECT trade_date, 0, 1 FROM dups) x
    GROUP BY trade_date""")
def import_trades_report(m: Market):
    cols = ["trade_id", "trade_date", "user_id", "stock_code", "quantity"]
    old = m.ledger.filter("trade_date < DATE '1999-01-01'").select(*cols)
    batch = m.ledger.filter("trade_date >= DATE '1998-06-01'").select(*cols)
    return merge.import_trades(old, batch)[2]


_POS = "SELECT position_id, user_id, position_date, market_value FROM positions"


@query("import_snapshots_refused", "positions", sql=f"""
    SELECT position_id FROM ({_POS} WHERE position_date >= DATE '1999-01-01') b
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, position_date FROM positions
                                 WHERE position_date < DATE '2000-01-01') d
                  WHERE d.user_id = b.user_id AND d.position_date = b.position_date)""")
def import_snapshots_refused(m: Market):
    p = m.positions.select("position_id", "user_id", "position_date", "market_value")
    _, refused = merge.import_snapshots(p.filter("position_date < DATE '2000-01-01'"),
                                        p.filter("position_date >= DATE '1999-01-01'"))
    return refused.select("position_id")


@query("import_snapshots_overwrite", "positions", sql=f"""
    SELECT position_id, market_value FROM ({_POS} WHERE position_date < DATE '1999-01-01') a
    UNION ALL SELECT position_id, market_value * 2.0::DOUBLE
    FROM ({_POS} WHERE position_date >= DATE '1999-01-01') b""")
def import_snapshots_overwrite(m: Market):
    p = m.positions.select("position_id", "user_id", "position_date", "market_value")
    batch = p.filter("position_date >= DATE '1999-01-01'").withColumn(
        "market_value", F.col("market_value") * 2.0)
    state, _ = merge.import_snapshots(p.filter("position_date < DATE '2000-01-01'"), batch, overwrite=True)
    return state.select("position_id", "market_value")


@query("reimport_account_days", "ledger", sql="""
    SELECT trade_id, user_id, trade_date, quantity FROM ledger
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, trade_date FROM ledger WHERE trade_type = 24) d
                      WHERE d.user_id = ledger.user_id AND d.trade_date = ledger.trade_date)
    UNION ALL SELECT trade_id, user_id, trade_date, -quantity FROM ledger WHERE trade_type = 24""")
def reimport_account_days(m: Market):
    cols = ["trade_id", "user_id", "trade_date", "quantity"]
    batch = m.ledger.filter("trade_type = 24").select(*cols).withColumn("quantity", -F.col("quantity"))
    return merge.reimport(m.ledger.select(*cols), batch)


_OPEN = """(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem
            WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)"""


def _weekdays(m: Market):
    ships = m.raw("lineitem").select(F.to_date("l_shipdate").alias("day"))
    return cal.trading_calendar(ships.filter(F.dayofweek("day").between(2, 6)))


@query("import_days_for_accounts", "ledger", sql=f"""
    SELECT trade_id FROM ledger WHERE trade_date IN (DATE '1998-03-10', DATE '1998-03-14', DATE '1998-03-16')
      AND trade_date IN (SELECT day FROM {_OPEN} c)""")
def import_days_for_accounts(m: Market):
    """14 March 1998 was a Saturday: skipped."""
    return merge.on_import_days(m.ledger, _weekdays(m), ["1998-03-10", "1998-03-14", "1998-03-16"],
                                date_col="trade_date").select("trade_id")


# --- load windows -----------------------------------------------------------

_PLAN = """
    SELECT s.code, t.table_name, t.latest, s2.start_day, s2.end_day, s2.start_day > s2.end_day AS skip,
           CASE WHEN t.table_name = 'daily_basic' OR s.code LIKE '%.BJ' THEN 'secondary'
                ELSE 'primary' END AS feed
    FROM securities s
    JOIN (SELECT s.code, 'price_data' AS table_name, x.d AS latest FROM securities s
          LEFT JOIN (SELECT code, max(day) AS d FROM bars_ev GROUP BY code) x ON x.code = s.code
          UNION ALL
          SELECT s.code, 'daily_basic', x.d FROM securities s
          LEFT JOIN (SELECT code, max(day) AS d FROM bars_ev WHERE day(day) < 20 AND code LIKE '%.SZ'
                     GROUP BY code) x ON x.code = s.code) t ON t.code = s.code,
    LATERAL (SELECT coalesce(t.latest + 1, greatest(s.start_date, DATE '2019-01-01')) AS start_day,
                    DATE '2024-01-30' AS end_day) s2"""


@query("load_plan", "securities", "bars_ev", sql=_PLAN)
def load_plan(m: Market):
    basic = m.bars_ev.filter("day(day) < 20 AND code LIKE '%.SZ'")
    return merge.load_plan(m.securities, {"price_data": (m.bars_ev, "day"), "daily_basic": (basic, "day")},
                           EVENTS_AS_OF)


@query("load_plan_applied", "securities", "bars_ev", sql="""
    SELECT b.code, b.day, b.close FROM bars_ev b JOIN securities s ON s.code = b.code
    LEFT JOIN (SELECT code, max(day) AS d FROM bars_ev WHERE day(day) < 20 GROUP BY code) x ON x.code = b.code
    WHERE b.day >= coalesce(x.d + 1, DATE '2019-01-01') AND b.day <= DATE '2024-01-28'""")
def load_plan_applied(m: Market):
    held = m.bars_ev.filter("day(day) < 20")
    plan = merge.load_plan(m.securities, {"price_data": (held, "day")}, "2024-01-28")
    return merge.apply_plan(plan, m.bars_ev, "price_data").select("code", "day", "close")


@query("batch_load_window", "bars_ev", sql="""
    SELECT code, day, close FROM bars_ev WHERE day > DATE '2024-01-19' AND day <= DATE '2024-01-25'""")
def batch_load_window(m: Market):
    held = m.bars_ev.filter("day(day) < 20")
    return merge.batch_window(held, m.bars_ev, "2024-01-25").select("code", "day", "close")


@query("single_day_load", "bars_ev", sql="SELECT code, day, close FROM bars_ev WHERE day = DATE '2024-01-11'")
def single_day_load(m: Market):
    return merge.batch_window(m.bars_ev, m.bars_ev, EVENTS_AS_OF, single_day="2024-01-11").select(
        "code", "day", "close")


@query("routed_feeds", "bars_ev", sql="""
    SELECT code, day, CASE WHEN code LIKE '%.BJ' THEN close * 2.0::DOUBLE ELSE close END AS close FROM bars_ev""")
def routed_feeds(m: Market):
    second = m.bars_ev.select("code", "day", (F.col("close") * 2.0).alias("close"))
    return merge.route_feeds(m.bars_ev.select("code", "day", "close"), second)


@query("master_staleness", "securities", sql="""
    SELECT max(update_date) AS update_date, count(*) AS n_rows,
           date_diff('day', max(update_date), DATE '2001-11-09') > 7 AS stale FROM securities""")
def master_staleness(m: Market):
    return merge.master_is_stale(m.securities, "2001-11-09")


@query("financial_refresh_due", "statements", sql="""
    SELECT max(stat_date) AS newest, date_diff('day', max(stat_date), DATE '2002-02-15') > 90 AS due
    FROM statements""")
def financial_refresh_due(m: Market):
    s = m.statements
    return merge.financials_due([s, s.filter("report_type = 0"), s.filter("report_type = 1")], "2002-02-15")


# --- clean-up ---------------------------------------------------------------

@query("non_trading_preview", "ledger", sql=f"""
    SELECT trade_date, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
           count(DISTINCT stock_code) AS n_codes FROM ledger
    WHERE trade_date NOT IN (SELECT day FROM {_OPEN} c) GROUP BY trade_date""")
def non_trading_preview(m: Market):
    return merge.non_trading_preview(m.ledger, _weekdays(m), "trade_date")


@query("non_trading_rows_dropped", "ledger", sql=f"""
    SELECT trade_id, trade_date FROM ledger WHERE trade_date IN (SELECT day FROM {_OPEN} c)""")
def non_trading_rows_dropped(m: Market):
    return merge.drop_non_trading_days(m.ledger, _weekdays(m), "trade_date").select("trade_id", "trade_date")


def _code_map(m: Market):
    codes = m.securities.filter("code LIKE '%.BJ'").select(
        F.substring_index("code", ".", 1).cast("long").alias("old_code"),
        (F.substring_index("code", ".", 1).cast("long") + F.when(F.col("code").like("%2.BJ"), 3).otherwise(920000))
        .cast("string").alias("new_code"))
    return codes


_MAP = """(SELECT code AS old, lpad(CAST(n AS VARCHAR), 6, '0') || '.BJ' AS new
           FROM (SELECT code, CAST(split_part(code, '.', 1) AS BIGINT)
                     + CASE WHEN code LIKE '%2.BJ' THEN 3 ELSE 920000 END AS n
                 FROM securities WHERE code LIKE '%.BJ' AND length(code) = 9) x WHERE n <= 999999)"""


@query("code_remap", "bars_li", "securities", sql=f"""
    SELECT coalesce(new, code) AS code, day, close FROM bars_li LEFT JOIN {_MAP} k ON code = old""")
def code_remap(m: Market):
    return merge.remap_codes(m.bars_li, _code_map(m)).select("code", "day", "close")


@query("code_remap_report", "bars_li", "securities", sql=f"""
    SELECT old AS old_code, new AS new_code, count(*) AS n_rows, count(t.code) AS n_collisions
    FROM bars_li b JOIN {_MAP} k ON b.code = old
    LEFT JOIN (SELECT code, day FROM bars_li) t ON t.code = new AND t.day = b.day
    GROUP BY old, new""")
def code_remap_report(m: Market):
    return merge.remap_report(m.bars_li, _code_map(m))


@query("version_rekey", "statements", sql="""
    SELECT code, stat_date, coalesce(v, 0) AS report_type, max(total_operating_revenue) AS revenue
    FROM (SELECT *, CASE WHEN report_type = 1 THEN NULL ELSE report_type END AS v FROM statements) x
    GROUP BY code, stat_date, coalesce(v, 0)""")
def version_rekey(m: Market):
    """Version 1 is unknown here, so it falls on version 0; the larger revenue stays."""
    s = m.statements.select("code", "stat_date", F.when(F.col("report_type") != 1, F.col("report_type"))
                            .alias("report_type"), (-F.col("total_operating_revenue")).alias("revenue"))
    return merge.with_version_key(s).withColumn("revenue", -F.col("revenue"))


@query("factor_backfill", "bars_ev", sql="""
    SELECT code, day, CASE WHEN code LIKE '%.BJ' AND day(day) % 2 = 0 THEN 2.5 ELSE factor END AS factor,
           CASE WHEN code LIKE '%.BJ' AND day(day) % 2 = 0 THEN 2.5::DOUBLE END AS adj_factor FROM bars_ev""")
def factor_backfill(m: Market):
    bars = m.bars_ev.select("code", "day", "factor", F.lit(None).cast("double").alias("adj_factor"))
    feed = m.bars_ev.filter("day(day) % 2 = 0").select("code", "day", F.lit(2.5).alias("adj_factor"))
    return merge.fill_factors(bars, feed)


@query("reload_verification", "statements", sql="""
    SELECT CAST(sum(n) AS BIGINT) AS stored_rows, count(*) AS n_keys,
           count(*) FILTER (v > 1) AS versioned_keys,
           (SELECT count(*) FROM statements) AS loaded_rows,
           sum(n) = (SELECT count(*) FROM statements) AS complete
    FROM (SELECT count(*) AS n, count(DISTINCT report_type) AS v FROM statements
          WHERE report_type <> 0 GROUP BY code, stat_date) x""")
def reload_verification(m: Market):
    return merge.reload_check(m.statements.filter("report_type <> 0"), m.statements)


@query("master_refresh", "securities", sql="""
    SELECT code, display_name, update_date, 'kept' AS state FROM securities WHERE code LIKE '%5.%'
    UNION ALL SELECT code, 'New ' || display_name, DATE '2002-01-01', 'loaded' FROM securities
    WHERE code NOT LIKE '%5.%' AND code NOT LIKE '%8.%'
    UNION ALL SELECT code, display_name, update_date, 'kept' FROM securities WHERE code LIKE '%8.%'""")
def master_refresh(m: Market):
    """Codes on 8 come without a name and are refused; codes on 5 are not listed."""
    from quotemill.sources.landed import align_to_schema

    old = align_to_schema(m.securities, "stock_list")
    new = old.filter("code NOT LIKE '%5.%'").withColumns({
        "display_name": F.when(~F.col("code").like("%8.%"), F.concat(F.lit("New "), "display_name")),
        "update_date": F.to_date(F.lit("2002-01-01"))})
    state, _ = merge.load_master(old, new)
    return state.select("code", "display_name", "update_date", F.when(
        F.year("update_date") == 2002, "loaded").otherwise("kept").alias("state"))


@query("generated_trade_ids", "ledger", sql="""
    SELECT count(*) AS n, count(DISTINCT row(user_id, trade_date, stock_code, price, quantity)) AS n_ids
    FROM ledger""")
def generated_trade_ids(m: Market):
    ids = m.ledger.select(tf.generated_trade_id("user_id", "trade_date", "stock_code", "price",
                                                "quantity").alias("id"))
    per_id = cov.count_by(ids, "id")
    return per_id.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_ids"))


@query("json_records", "securities", sql="""
    SELECT '{"code":"' || code || '","end_date":'
           || CASE WHEN end_date IS NULL THEN 'null' ELSE '"' || end_date || '"' END
           || ',"gap":null}' AS value FROM securities""")
def json_records(m: Market):
    return tables.records(m.securities.select("code", "end_date", F.lit(float("nan")).alias("gap")))




def _by_year(m: Market, df, day: str) -> str:
    """A table stored by year in the shared folder."""
    path = f"{shared_dir(m.spark, 'by-year')}/rows"
    merge.write_partitions(df.withColumn("part_year", F.year(day)), path, ["part_year"])
    return path


@query("upsert_stored_years", "bars_li", sql=f"""
    SELECT * FROM {_LI_OLD} o WHERE day < DATE '2001-01-01' UNION ALL SELECT * FROM {_LI_NEW} n""")
def upsert_stored_years(m: Market):
    """Two versions of each key of a year; the other years' files stay as they are."""
    path = _by_year(m, _old(m), "day")
    new = _new(m).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({
        "close": F.col("close") + F.when(F.col("version") == 1, 1000.0).otherwise(0.0),
        "part_year": F.year("day")})
    merge.upsert_stored(path, new, ["code", "day"], ["version"], "part_year")
    return m.spark.read.parquet(path).select("code", "day", "close")


@query("upsert_stored_moved", "ledger", sql="""
    WITH x AS (SELECT trade_id, user_id, CASE WHEN trade_id LIKE '%7-1' AND year(trade_date) < 1994
                      THEN trade_date + 366 ELSE trade_date END AS trade_date FROM ledger)
    SELECT DISTINCT trade_id, user_id, trade_date FROM x""")
def upsert_stored_moved(m: Market):
    """Trades whose corrected date lies in another folder leave the old one."""
    trades = m.ledger.select("trade_id", "user_id", "trade_date").distinct()
    path = _by_year(m, trades, "trade_date")
    moved = trades.filter("trade_id LIKE '%7-1' AND year(trade_date) < 1994").withColumn(
        "trade_date", F.date_add("trade_date", 366)).withColumn("part_year", F.year("trade_date"))
    merge.upsert_stored(path, moved, ["trade_id"], ["trade_date"], "part_year")
    return m.spark.read.parquet(path).select("trade_id", "user_id", "trade_date")


@query("delete_update_stored", "bars_li", sql="""
    SELECT code, day, CASE WHEN day = DATE '1995-03-10' THEN -1.0::DOUBLE ELSE close END AS close
    FROM bars_li WHERE day <> DATE '1997-05-06'""")
def delete_update_stored(m: Market):
    path = _by_year(m, m.bars_li.select("code", "day", "close"), "day")
    merge.delete_stored(m.spark, path, "part_year", day=dt.date(1997, 5, 6))
    merge.update_stored(m.spark, path, "part_year", {"close": -1.0}, day=dt.date(1995, 3, 10))
    return m.spark.read.parquet(path).select("code", "day", "close")


_CHANGED = """(SELECT code, day, CASE WHEN code LIKE '%1.SZ' AND year(day) = 1996 THEN close + 1 ELSE close END AS close,
                      volume FROM bars_li WHERE NOT (code LIKE '%2.BJ' AND day < DATE '1994-01-01')
               UNION ALL SELECT code, day + 20000, close, volume FROM bars_li WHERE day = DATE '1998-02-03')"""


@query("reload_contents", "bars_li", sql=f"""
    SELECT coalesce(a.code, b.code) AS code, coalesce(a.day, b.day) AS day,
           CAST(count(a.code) AS BIGINT) AS left_rows, CAST(count(b.code) AS BIGINT) AS right_rows,
           CASE WHEN count(a.code) = 0 THEN 'extra' WHEN count(b.code) = 0 THEN 'missing' ELSE 'changed' END AS state
    FROM bars_li a FULL JOIN {_CHANGED} b ON a.code = b.code AND a.day = b.day
    WHERE a.code IS NULL OR b.code IS NULL OR a.close <> b.close OR a.volume <> b.volume GROUP BY 1, 2""")
def reload_contents(m: Market):
    """Contents after a reload against those before: changed, missing and extra keys, found by sums."""
    old = m.bars_li.select("code", "day", "close", "volume")
    new = old.filter("NOT (code LIKE '%2.BJ' AND day < DATE '1994-01-01')").withColumn(
        "close", F.when(F.expr("code LIKE '%1.SZ' AND year(day) = 1996"), F.col("close") + 1).otherwise(F.col("close")))
    extra = old.filter("day = DATE '1998-02-03'").withColumn("day", F.date_add("day", 20000))
    before, after = _by_year(m, old, "day"), _by_year(m, new.unionByName(extra), "day")
    return merge.content_diff(m.spark.read.parquet(before), m.spark.read.parquet(after),
                              ["code", "day"], "part_year")


# --- figures kept up to date over loads ---------------------------------------

def _five_loads(m: Market, rows, key: str, kept: kept_states.Figures):
    """The rows come in five loads, each with rows of all years; the last one runs twice.

    They are dealt into folders of the loads first, so that the tables they come from are read once.
    """
    work = shared_dir(m.spark, "kept")
    rows = rows.withColumn("part_year", F.year(F.col(key)))
    dealt = rows.withColumn("load_no", F.pmod(F.xxhash64(*rows.columns), F.lit(5)).cast("int"))
    dealt.write.option("compression", "zstd").partitionBy("load_no").parquet(f"{work}/loads")
    loads = m.spark.read.schema(dealt.schema).parquet(f"{work}/loads")
    for i in (0, 1, 2, 3, 4, 4):
        batch = loads.filter(F.col("load_no") == i).select(*rows.columns)
        if kept_states.add_load(f"{work}/states", batch, kept, i + 1):
            merge.append(batch, f"{work}/table", ("part_year",))
    return f"{work}/table", f"{work}/states"


@query("kept_net_positions", "ledger", sql=f"""
    SELECT user_id, stock_code, {dsum("CASE WHEN trade_type = 23 THEN quantity ELSE -quantity END")} AS total_quantity,
           {dsum("CASE WHEN trade_type = 23 THEN net_amount ELSE -net_amount END")} AS total_amount, count(*) AS transaction_count
    FROM ledger WHERE trade_date <> DATE '1995-05-05' GROUP BY user_id, stock_code HAVING total_quantity > 0""")
def kept_net_positions(m: Market):
    """Net positions from kept states: five loads, then a day is deleted."""
    kept = kept_states.position_figures("part_year")
    table, states = _five_loads(m, m.ledger.select("trade_id", "user_id", "stock_code", "trade_date", "trade_type", "quantity",
                                                   "net_amount"), "trade_date", kept)
    kept_states.delete_rows(table, states, m.spark, kept, trade_date=dt.date(1995, 5, 5))
    return kept_states.net_positions(m.spark.read.parquet(states), kept)


@query("kept_latest_rows", "bars_li", sql="""
    SELECT code, max(day) AS latest_date, min(day) AS first_date, count(*) AS days, max_by(close, day) AS close,
           max_by(volume, day) AS volume
    FROM bars_li WHERE day <> DATE '2001-10-28' GROUP BY code""")
def kept_latest_rows(m: Market):
    """The newest bar and the dates of every code from kept states."""
    kept = kept_states.Figures(keys=("code",), folder="part_year", counts={"days": "day"}, least={"first_date": "day"},
                               greatest={"latest_date": "day"}, newest={"newest": ["day", "close", "volume"]})
    table, states = _five_loads(m, m.bars_li.select("code", "day", "close", "volume"), "day", kept)
    kept_states.delete_rows(table, states, m.spark, kept, day=dt.date(2001, 10, 28))
    now = kept_states.figures(m.spark.read.parquet(states), kept)
    return now.select("code", "latest_date", "first_date", "days", "newest.close", "newest.volume")


@query("kept_position_summary", "positions", sql=f"""
    SELECT user_id, position_date, count(*) AS total_positions, count(DISTINCT stock_code) AS unique_stocks,
           CAST(sum(CAST(position_quantity AS BIGINT)) AS BIGINT) AS total_quantity, {dsum('market_value')} AS total_market_value,
           {dsum('unrealized_pnl')} AS total_unrealized_pnl
    FROM (SELECT *, max(position_date) OVER (PARTITION BY user_id) AS newest FROM positions) x
    WHERE position_date = newest AND position_quantity > 0 GROUP BY user_id, position_date""")
def kept_position_summary(m: Market):
    """The newest book per user from kept states per user and date; a stock occurs once in a book."""
    held = F.col("position_quantity") > 0
    kept = kept_states.Figures(
        keys=("user_id", "position_date"), folder="part_year", counts={"total_positions": F.when(held, 1)},
        sums={"total_quantity": F.when(held, F.col("position_quantity").cast("bigint")),
              "total_market_value": F.when(held, F.col("market_value")), "total_unrealized_pnl": F.when(held, F.col("unrealized_pnl"))})
    _, states = _five_loads(m, m.positions.select("user_id", "stock_code", "position_date", "position_quantity", "market_value",
                                                  "unrealized_pnl"), "position_date", kept)
    books = kept_states.figures(m.spark.read.parquet(states), kept)
    newest = books.groupBy("user_id").agg(F.max("position_date").alias("position_date"))
    return (books.join(newest, ["user_id", "position_date"], "left_semi").filter("total_positions > 0")
            .withColumn("unique_stocks", F.col("total_positions")).withColumn("total_quantity", F.col("total_quantity").cast("bigint"))
            .drop("_rows"))
