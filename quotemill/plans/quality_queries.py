"""Data quality queries. Samples are joined to one text, so results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import calendar as cal
from quotemill.operators import coverage as cov
from quotemill.plans.market import EVENTS_AS_OF, LEDGER_AS_OF, Market
from quotemill.plans.quality_run_sql import VIEWS_OF_A_RUN, routine_sql, run_sql
from quotemill.plans.registry import query
from quotemill.quality import checks, report, runner, sql_rules
from quotemill.quality.issues import union_issues
from quotemill.quality.rules import judge_rows, standard_rules, statement_rules

_THRESHOLDS = {"user_data_start_date": "1995-06-01", "min_active_securities": 95,
               "max_extreme_prices": 10, "max_invalid_ratios": 50, "max_extreme_valuations": 5}


def flat(issues: DataFrame) -> DataFrame:
    return issues.select("severity", "category", "table_name", "check_name", "count",
                         F.array_join("samples", ";").alias("samples"))


def figures(issues: DataFrame) -> DataFrame:
    return issues.select("severity", "category", "table_name", "check_name", "count")


def _samples(rows: str, text: str, n: int = 5) -> str:
    return (f"(SELECT coalesce(string_agg(t, ';' ORDER BY t), '') FROM "
            f"(SELECT {text} AS t FROM {rows} ORDER BY 1 LIMIT {n}) s)")


def _rule_sql(cases: list[tuple], table: str, source: str) -> str:
    """UNION of single-rule counts: (name, category, severity, bad, allowed, sample text)."""
    parts = []
    for name, category, severity, bad, allowed, text in cases:
        shown = _samples(f"{source} WHERE {bad}", text) if text else "''"
        parts.append(f"SELECT '{severity}' AS severity, '{category}' AS category, '{table}' AS table_name, "
                     f"'{name}' AS check_name, count(*) AS count, {shown} AS samples "
                     f"FROM {source} WHERE {bad} HAVING count(*) > {allowed}")
    return " UNION ALL ".join(parts)


def _rules(table: str, level_rules=None):
    return [r for r in (level_rules or standard_rules(_THRESHOLDS, LEDGER_AS_OF)) if r.table == table]


@query("rules_securities", "securities", sql=_rule_sql([
    ("exchange_code_validation", "accuracy", "warning", "exchange NOT IN ('XSHG', 'XSHE', 'BSE')", 0, None),
    ("required_fields_not_null_display_name", "completeness", "critical", "display_name IS NULL", 0, None),
    ("stock_code_format", "accuracy", "critical", "right(code, 3) NOT IN ('.SH', '.SZ', '.BJ')", 0, None),
    ("date_logic_validation", "accuracy", "critical", "end_date < start_date", 0, None),
], "stock_list", """(SELECT code, start_date,
        CASE WHEN code LIKE '%2.SH' THEN NULL ELSE display_name END AS display_name,
        CASE WHEN code LIKE '%7.SZ' THEN 'NYSE' ELSE exchange END AS exchange,
        CASE WHEN code LIKE '%7.BJ' THEN DATE '1990-01-01' ELSE end_date END AS end_date
      FROM securities) q"""))
def rules_securities(m: Market):
    """Faults planted by code pattern."""
    code = F.col("code")
    faulty = m.securities.withColumns({
        "display_name": F.when(~code.like("%2.SH"), F.col("display_name")),
        "exchange": F.when(code.like("%7.SZ"), "NYSE").otherwise(F.col("exchange")),
        "end_date": F.when(code.like("%7.BJ"), F.to_date(F.lit("1990-01-01")))
        .otherwise(F.col("end_date"))})
    return flat(judge_rows(faulty, _rules("stock_list")))


@query("rules_prices", "bars_ev", "securities", sql=_rule_sql([
    ("price_range_validation", "accuracy", "warning",
     "(high > close * 1.15::DOUBLE OR low < close * 0.85::DOUBLE OR close > 1000 OR close < 0.01)", 9, None),
    ("price_logic_validation", "accuracy", "critical", "(high < low OR volume < 0)", 0,
     "'(' || code || ', ' || day || ')'"),
    ("required_fields_not_null_open", "completeness", "critical", "open IS NULL", 0, None),
], "price_data", """(SELECT p.code, p.day, p.high, p.low, p.close,
        CASE WHEN p.code LIKE '%3.SH' THEN NULL ELSE p.open END AS open,
        CASE WHEN day(p.day) = 17 THEN -p.volume ELSE p.volume END AS volume
      FROM bars_ev p JOIN securities s ON p.code = s.code AND p.day >= s.start_date
        AND (s.end_date IS NULL OR p.day <= s.end_date)) q"""))
def rules_prices(m: Market):
    faulty = m.bars_ev.withColumns({
        "open": F.when(~F.col("code").like("%3.SH"), F.col("open")),
        "volume": F.when(F.day("day") == 17, -F.col("volume")).otherwise(F.col("volume"))})
    rules = [r for r in _rules("price_data") if r.listed_only]
    return flat(judge_rows(cov.within_listing(faulty, m.securities), rules))


@query("rule_price_bracket", "bars_ev", sql=_rule_sql([
    ("price_bracket_validation", "accuracy", "warning",
     "(high < greatest(open, close) OR low > least(open, close))", 0, "'(' || code || ', ' || day || ')'"),
], "price_data", """(SELECT code, day, open, close, low,
        CASE WHEN day(day) = 5 THEN low ELSE high END AS high FROM bars_ev) q"""))
def rule_price_bracket(m: Market):
    faulty = m.bars_ev.withColumn("high", F.when(F.day("day") == 5, F.col("low")).otherwise(F.col("high")))
    rules = [r for r in _rules("price_data") if r.name == "price_bracket_validation"]
    return flat(judge_rows(faulty, rules))


@query("rules_valuation", "valuation", "securities", sql=_rule_sql([
    ("valuation_ratios_reasonableness", "accuracy", "warning",
     "(pe_ratio < -1000 OR pe_ratio > 1000 OR pb_ratio < 0 OR pb_ratio > 100 OR market_cap < 0)", 4, None),
], "valuation_data", """(SELECT v.* REPLACE (CASE WHEN day(v.day) = 11 THEN -v.market_cap
        ELSE v.market_cap END AS market_cap) FROM valuation v JOIN securities s ON v.code = s.code
        AND v.day >= s.start_date AND (s.end_date IS NULL OR v.day <= s.end_date)) q"""))
def rules_valuation(m: Market):
    faulty = m.valuation.withColumn("market_cap", F.when(
        F.day("day") == 11, -F.col("market_cap")).otherwise(F.col("market_cap")))
    return flat(judge_rows(cov.within_listing(faulty, m.securities), _rules("valuation_data")))


@query("rules_indicators", "indicators", sql=_rule_sql([
    ("financial_ratios_validation", "accuracy", "warning",
     "(abs(eps) > 100 OR roe < -1 OR roe > 1 OR roa < -1 OR roa > 1)", 49, None),
], "indicator_data", "indicators"))
def rules_indicators(m: Market):
    return flat(judge_rows(m.indicators, _rules("indicator_data")))


_TRADE = "'(' || user_id || ', ' || trade_id || ', ' || stock_code || ')'"


@query("rules_transactions", "ledger", sql=_rule_sql([
    ("trade_type_validation", "accuracy", "critical", "trade_type NOT IN (23, 24)", 0, _TRADE),
    ("quantity_price_validation", "accuracy", "critical", "(quantity <= 0 OR price <= 0)", 0, _TRADE),
    ("amount_calculation_accuracy", "accuracy", "warning",
     "(quantity > 0 AND price > 0 AND amount > 0 AND abs(quantity * price - amount) / nullif(amount, 0) > 0.05)",
     0, _TRADE),
    ("trade_date_validation", "accuracy", "warning", f"trade_date > DATE '{LEDGER_AS_OF}'", 0, _TRADE),
], "user_transactions", """(SELECT trade_id, user_id, stock_code, trade_date, price,
        CASE WHEN day(trade_date) = 2 AND stock_code LIKE '%1.SH' THEN 99 ELSE trade_type END AS trade_type,
        CASE WHEN day(trade_date) = 3 AND stock_code LIKE '%4.SZ' THEN -quantity ELSE quantity END AS quantity,
        CASE WHEN day(trade_date) = 4 AND stock_code LIKE '%5.BJ' THEN amount * 1.25::DOUBLE ELSE amount END AS amount
      FROM ledger) q"""))
def rules_transactions(m: Market):
    dom, code = F.day("trade_date"), F.col("stock_code")
    faulty = m.ledger.withColumns({
        "trade_type": F.when((dom == 2) & code.like("%1.SH"), 99).otherwise(F.col("trade_type")),
        "quantity": F.when((dom == 3) & code.like("%4.SZ"), -F.col("quantity")).otherwise(F.col("quantity")),
        "amount": F.when((dom == 4) & code.like("%5.BJ"), F.col("amount") * 1.25).otherwise(F.col("amount"))})
    return flat(judge_rows(faulty, _rules("user_transactions")))


_SHARE = "'(' || user_id || ', ' || position_date || ', ' || stock_code || ')'"


@query("rules_positions", "positions", sql=_rule_sql([
    ("position_quantity_logic", "accuracy", "critical",
     "(position_quantity < 0 OR available_quantity < 0 OR frozen_quantity > position_quantity "
     "OR available_quantity + frozen_quantity > position_quantity)", 0, _SHARE),
    ("market_value_calculation", "accuracy", "warning",
     "(position_quantity > 0 AND current_price > 0 AND market_value > 0 AND "
     "abs(position_quantity * current_price - market_value) / nullif(market_value, 0) > 0.05)", 0, _SHARE),
], "user_positions", "positions"))
def rules_positions(m: Market):
    return flat(judge_rows(m.positions, _rules("user_positions")))


_ACCOUNT = "'(' || user_id || ', ' || info_date || ')'"


@query("rules_accounts", "accounts", sql=_rule_sql([
    ("asset_balance_check", "accuracy", "warning",
     "(total_assets > 0 AND abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10 "
     "AND info_date >= DATE '1995-06-01')", 0, _ACCOUNT),
    ("negative_amounts_check", "accuracy", "warning",
     "(total_assets < 0 OR position_market_value < 0 OR available_cash < 0 OR frozen_cash < 0)", 0, _ACCOUNT),
], "user_account_info", "accounts"))
def rules_accounts(m: Market):
    return flat(judge_rows(m.accounts, _rules("user_account_info")))


@query("rule_statement_balance", "statements", sql=_rule_sql([
    ("statement_balance", "accuracy", "warning",
     "abs(total_assets - (total_liability + total_sheet_owner_equities)) / nullif(abs(total_assets), 0) > 0.01",
     0, "'(' || code || ', ' || stat_date || ')'"),
], "balance_sheet", "statements"))
def rule_statement_balance(m: Market):
    return flat(judge_rows(m.statements, statement_rules()))


@query("check_tables_empty", "securities", "margin", sql="""
    SELECT 'critical' AS severity, 'completeness' AS category, 'mtss_data' AS table_name,
           'table_not_empty' AS check_name, count(*) AS count
    FROM margin WHERE fin_value < 0 HAVING count(*) = 0""")
def check_tables_empty(m: Market):
    return figures(checks.table_empty(m.securities, "stock_list").unionByName(
        checks.table_empty(m.margin.filter("fin_value < 0"), "mtss_data")))


@query("check_null_ratios", "indicators", sql="""
    SELECT CASE WHEN n > 0.30 * total THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'indicator_data' AS table_name,
           'null_ratio_' || c AS check_name, n AS count
    FROM (SELECT 'eps' AS c, count(*) FILTER (eps IS NULL) AS n, count(*) AS total FROM indicators
          UNION ALL SELECT 'roe', count(*) FILTER (month("statDate") IN (3, 6)), count(*)
          FROM indicators) x WHERE n > 0.10 * total""")
def check_null_ratios(m: Market):
    faulty = m.indicators.withColumn("roe", F.when(~F.month("statDate").isin(3, 6), F.col("roe")))
    return figures(checks.null_ratios(faulty, "indicator_data"))


@query("check_duplicate_keys", "ledger", sql=f"""
    SELECT 'critical' AS severity, 'uniqueness' AS category, 'user_transactions' AS table_name,
           'primary_key_unique' AS check_name, CAST(sum(n - 1) AS BIGINT) AS count,
           {_samples("(SELECT trade_id FROM ledger GROUP BY trade_id HAVING count(*) > 1) d",
                     "'(' || trade_id || ')'", 10)} AS samples
    FROM (SELECT trade_id, count(*) AS n FROM ledger GROUP BY trade_id HAVING count(*) > 1) x
    HAVING count(*) > 0""")
def check_duplicate_keys(m: Market):
    return flat(checks.duplicate_key(m.ledger, "user_transactions"))


_CAL = "(SELECT DISTINCT day FROM bars_li)"
_DONE = f"""
    cal AS {_CAL},
    spans AS (SELECT code, greatest(start_date, DATE '1996-01-01') AS a,
                     least(coalesce(end_date, l.d), l.d) AS b
              FROM (SELECT * FROM securities WHERE end_date IS NULL OR end_date > DATE '{LEDGER_AS_OF}') s,
                   (SELECT max(day) AS d FROM cal WHERE day <= DATE '{LEDGER_AS_OF}') l),
    done AS (SELECT s.code, e.n AS expected, h.n AS actual, least(1.0, h.n / e.n) AS c
             FROM spans s JOIN (SELECT code, count(day) AS n FROM spans JOIN cal ON day BETWEEN a AND b
                                GROUP BY code) e ON s.code = e.code
             JOIN (SELECT s.code, count(p.day) AS n FROM spans s LEFT JOIN
                     (SELECT * FROM bars_li WHERE NOT (code LIKE '%4.SZ' AND day > DATE '2000-01-01')) p
                     ON p.code = s.code AND p.day BETWEEN a AND b GROUP BY s.code) h ON s.code = h.code)"""


def _thin_prices(m: Market):
    return m.bars_li.filter("NOT (code LIKE '%4.SZ' AND day > DATE '2000-01-01')")


@query("check_price_completeness", "bars_li", "securities", sql=f"""
    WITH {_DONE}
    SELECT CASE WHEN 1 - c > 0.2 THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'price_data' AS table_name,
           'price_completeness' AS check_name, expected - actual AS count, code AS samples
    FROM done WHERE round(c, 6) < 0.95
    UNION ALL
    SELECT 'warning', 'completeness', 'price_data', 'price_completeness_summary',
           count(*) FILTER (round(c, 6) < 0.95), '' FROM done
    HAVING count(*) FILTER (round(c, 6) < 0.95) > 0.1 * count(*)""")
def check_price_completeness(m: Market):
    import datetime as dt

    return flat(checks.price_completeness(
        m.securities, _thin_prices(m), cal.trading_calendar(m.bars_li), LEDGER_AS_OF,
        floor=dt.date(1996, 1, 1)))


@query("check_series_completeness", "bars_li", "securities", sql=f"""
    WITH {_DONE}
    SELECT 'warning' AS severity, 'completeness' AS category, 'price_data' AS table_name,
           'time_series_completeness' AS check_name, count(*) AS count
    FROM done WHERE round(c, 6) < 0.95 HAVING count(*) > 0""")
def check_series_completeness(m: Market):
    import datetime as dt

    return figures(checks.series_completeness(
        m.securities, _thin_prices(m), cal.trading_calendar(m.bars_li), LEDGER_AS_OF,
        floor=dt.date(1996, 1, 1)))


@query("check_abnormal_moves", "bars_ev", sql=f"""
    SELECT 'warning' AS severity, 'accuracy' AS category, 'price_data' AS table_name,
           'abnormal_volatility' AS check_name, count(*) AS count
    FROM (SELECT close, lag(close) OVER (PARTITION BY code ORDER BY day) AS prev FROM bars_ev
          WHERE day >= DATE '{EVENTS_AS_OF}' - 30) x
    WHERE prev > 0 AND abs(close - prev) / nullif(prev, 0) > 0.5 HAVING count(*) > 0""")
def check_abnormal_moves(m: Market):
    return figures(checks.abnormal_moves(m.bars_ev, EVENTS_AS_OF))


@query("check_breadth", "bars_ev", "indicators", "securities", sql="""
    SELECT 'warning' AS severity, 'completeness' AS category, 'price_data' AS table_name,
           'recent_data_availability' AS check_name, count(DISTINCT code) AS count
    FROM bars_ev WHERE day >= DATE '2024-02-02' - 3 HAVING count(DISTINCT code) < 4880
    UNION ALL
    SELECT 'warning', 'completeness', 'indicator_data', 'quarterly_data_completeness',
           count(DISTINCT code) FROM indicators
    WHERE "statDate" >= date_trunc('quarter', DATE '2001-11-04' - INTERVAL 3 MONTH)
    HAVING count(DISTINCT code) < 4340
    UNION ALL
    SELECT 'warning', 'completeness', 'stock_list', 'active_stocks_coverage', count(*) FROM securities
    WHERE (end_date IS NULL OR end_date > DATE '2001-11-04') AND status = 'normal'
    HAVING count(*) < 4000""")
def check_breadth(m: Market):
    return figures(union_issues([
        checks.recent_breadth(m.bars_ev, "2024-02-02", 4880),
        checks.quarter_breadth(m.indicators, LEDGER_AS_OF, 4340),
        checks.active_breadth(m.securities, LEDGER_AS_OF, 4000)], m.spark))


_DAYS = ["1999-03-10", "1999-03-11", "2000-08-01"]
_DAYS_SQL = ", ".join(f"(DATE '{d}')" for d in _DAYS)
_EXPECTED = f"""(SELECT s.code, d.day FROM {{src}} s, (VALUES {_DAYS_SQL}) d(day)
                 WHERE s.start_date <= d.day AND (s.end_date IS NULL OR s.end_date > d.day))"""
_HOLES = "(SELECT * FROM bars_li WHERE NOT (day(day) = 10 AND code LIKE '%.SH'))"


def _holes(m: Market):
    return m.bars_li.filter(~((F.day("day") == 10) & F.col("code").endswith(".SH")))


@query("check_price_day_coverage", "bars_li", "securities", sql=f"""
    WITH e AS {_EXPECTED.format(src='securities')}, p AS {_HOLES},
         f AS (SELECT day, count(*) AS expected,
                      (SELECT count(DISTINCT code) FROM p WHERE p.day = e.day) AS actual
               FROM e GROUP BY day)
    SELECT CASE WHEN 1 - actual / expected > 0.2 THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'price_data' AS table_name,
           'price_day_coverage' AS check_name, expected - actual AS count,
           (SELECT coalesce(string_agg(code, ';' ORDER BY code), '') FROM (
              SELECT e.code, row_number() OVER (ORDER BY e.code) AS k FROM e
              WHERE e.day = f.day AND NOT EXISTS (SELECT 1 FROM p WHERE p.code = e.code AND p.day = e.day))
            s WHERE k <= 5) AS samples
    FROM f WHERE actual < expected * 0.95""")
def check_price_day_coverage(m: Market):
    return flat(checks.price_day_coverage(m.securities, _holes(m), _DAYS))


@query("check_price_day_sampled", "bars_li", "securities", sql=f"""
    WITH e AS {_EXPECTED.format(src="(SELECT * FROM securities ORDER BY md5(code || '5'), code LIMIT 50)")},
         p AS {_HOLES}
    SELECT 'warning' AS severity, 'completeness' AS category, 'price_data' AS table_name,
           'price_day_sampled' AS check_name, count(*) FILTER (p.code IS NULL) AS count
    FROM e LEFT JOIN p ON p.code = e.code AND p.day = e.day GROUP BY e.day
    HAVING count(*) FILTER (p.code IS NULL) > 0.1 * count(*)""")
def check_price_day_sampled(m: Market):
    return figures(checks.price_day_sampled(m.securities, _holes(m), _DAYS, 50, "5"))


@query("check_valuation_coverage", "bars_li", "valuation", sql="""
    WITH p AS (SELECT * FROM bars_li WHERE code NOT LIKE '%.BJ'),
         miss AS (SELECT p.code, p.day FROM p WHERE NOT EXISTS (
                    SELECT 1 FROM valuation v WHERE v.code = p.code AND v.day = p.day)),
         f AS (SELECT t.day, t.n AS total, m.n FROM (SELECT day, count(*) AS n FROM p GROUP BY day) t
               JOIN (SELECT day, count(*) AS n FROM miss GROUP BY day) m ON t.day = m.day)
    SELECT CASE WHEN n / total > 0.5 THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'valuation_data' AS table_name,
           'valuation_data_day_coverage' AS check_name, n AS count,
           (SELECT string_agg(code, ';' ORDER BY code) FROM (
              SELECT code, row_number() OVER (ORDER BY code) AS k FROM miss WHERE miss.day = f.day) s
            WHERE k <= 5) AS samples
    FROM f WHERE n / total > 0.1""")
def check_valuation_coverage(m: Market):
    return flat(checks.daily_alignment(m.bars_li, m.valuation, "valuation_data"))


@query("check_indicator_coverage", "bars_li", "indicators", sql="""
    SELECT CASE WHEN n / total > 0.5 THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'indicator_data' AS table_name,
           'indicator_data_day_coverage' AS check_name, n AS count
    FROM (SELECT p.day, count(*) AS total, count(*) FILTER (i.code IS NULL) AS n FROM bars_li p
          LEFT JOIN indicators i ON i.code = p.code AND i."statDate" = p.day GROUP BY p.day) x
    WHERE n / total > 0.1""")
def check_indicator_coverage(m: Market):
    return figures(checks.daily_alignment(m.bars_li, m.indicators, "indicator_data", "statDate",
                                          skip_suffix=None))


_REPORTS = """(SELECT * FROM indicators WHERE NOT (code LIKE '%.SZ' AND "statDate" = DATE '1998-12-31'))"""


@query("check_report_coverage", "securities", "indicators", sql=f"""
    WITH e AS (SELECT *, CASE WHEN month(day) <= 3 THEN make_date(year(day) - 1, 12, 31)
                              WHEN month(day) <= 4 THEN make_date(year(day), 3, 31)
                              WHEN month(day) <= 8 THEN make_date(year(day), 6, 30)
                              WHEN month(day) <= 10 THEN make_date(year(day), 9, 30)
                              ELSE make_date(year(day), 12, 31) END AS q
               FROM {_EXPECTED.format(src='securities')} b),
         f AS (SELECT day, q, count(*) AS expected,
                      (SELECT count(DISTINCT code) FROM {_REPORTS} i WHERE i."statDate" = e.q) AS actual
               FROM e GROUP BY day, q)
    SELECT CASE WHEN 1 - actual / expected > 0.5 THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'indicator_data' AS table_name,
           'report_coverage' AS check_name, expected - actual AS count
    FROM f WHERE 1 - actual / expected > 0.3""")
def check_report_coverage(m: Market):
    gaps = m.indicators.filter("NOT (code LIKE '%.SZ' AND statDate = DATE '1998-12-31')")
    return figures(checks.report_coverage(m.securities, gaps, _DAYS))


@query("check_quarterly_freshness", "indicators", sql="""
    WITH r AS (SELECT * FROM indicators WHERE code NOT LIKE '%.BJ' AND "statDate" >= DATE '1999-01-01'),
         q AS (SELECT "statDate" AS d, count(*) AS n FROM r GROUP BY 1),
         e(d) AS (VALUES (DATE '2002-09-30'), (DATE '2002-06-30'), (DATE '2002-03-31'), (DATE '2001-12-31'))
    SELECT 'warning' AS severity, 'completeness' AS category, 'indicator_data' AS table_name,
           'quarter_stale' AS check_name, CAST(1 AS BIGINT) AS count FROM q
    HAVING max(d) < DATE '2002-09-15' - 180
    UNION ALL SELECT 'warning', 'completeness', 'indicator_data', 'quarters_missing', count(*)
    FROM e WHERE d NOT IN (SELECT d FROM q) HAVING count(*) > 0
    UNION ALL SELECT 'warning', 'completeness', 'indicator_data', 'quarter_thin', q.n
    FROM e JOIN q ON e.d = q.d WHERE q.n < 3000
    UNION ALL SELECT 'warning', 'accuracy', 'indicator_data', 'mostly_null_eps',
           count(*) FILTER (eps IS NULL) FROM r HAVING count(*) FILTER (eps IS NULL) > 0.5 * count(*)
    UNION ALL SELECT 'warning', 'accuracy', 'indicator_data', 'mostly_null_roe',
           count(*) FILTER (roe IS NULL) FROM r HAVING count(*) FILTER (roe IS NULL) > 0.5 * count(*)""")
def check_quarterly_freshness(m: Market):
    return figures(checks.quarterly_freshness(m.indicators, "2002-09-15", "1999-01-01"))


@query("check_master_basics", "securities", sql="""
    SELECT CASE WHEN c = 'code' OR n > 0.1 * total THEN 'critical' ELSE 'warning' END AS severity,
           'completeness' AS category, 'stock_list' AS table_name, 'null_' || c AS check_name, n AS count
    FROM (SELECT 'display_name' AS c, count(*) FILTER (code LIKE '%2.SH') AS n, count(*) AS total
          FROM securities) x WHERE n > 0""")
def check_master_basics(m: Market):
    faulty = m.securities.withColumn("display_name", F.when(
        ~F.col("code").like("%2.SH"), F.col("display_name")))
    return figures(checks.master_basics(faulty))


@query("check_unknown_codes", "bars_ev", "securities", sql=f"""
    SELECT 'warning' AS severity, 'completeness' AS category, 'price_data' AS table_name,
           'stock_code_reference_integrity' AS check_name, count(*) AS count,
           {_samples("(SELECT DISTINCT code FROM bars_ev WHERE code NOT IN (SELECT code FROM securities)) d", "code")} AS samples
    FROM bars_ev WHERE code NOT IN (SELECT code FROM securities) HAVING count(*) > 0""")
def check_unknown_codes(m: Market):
    return flat(checks.unknown_stock_codes(m.bars_ev, m.securities, "price_data", "code"))


_OPEN = """(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem
            WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)"""


def _weekdays(m: Market):
    ships = m.raw("lineitem").select(F.to_date("l_shipdate").alias("day"))
    return cal.trading_calendar(ships.filter(F.dayofweek("day").between(2, 6)))


@query("check_non_trading_days", "ledger", sql=f"""
    SELECT 'critical' AS severity, 'completeness' AS category, 'user_transactions' AS table_name,
           'non_trading_day_transactions' AS check_name, count(*) AS count,
           {_samples(f"(SELECT DISTINCT trade_date FROM ledger WHERE trade_date >= DATE '1995-06-01' AND trade_date NOT IN (SELECT day FROM {_OPEN} c)) d", "CAST(trade_date AS VARCHAR)")} AS samples
    FROM ledger WHERE trade_date >= DATE '1995-06-01' AND trade_date NOT IN (SELECT day FROM {_OPEN} c)
    HAVING count(*) > 0""")
def check_non_trading_days(m: Market):
    return flat(checks.non_trading_days(m.ledger, _weekdays(m), "user_transactions", "trade_date",
                                        "1995-06-01", "non_trading_day_transactions", "critical"))


@query("check_snapshot_gaps", "positions", sql="""
    SELECT 'warning' AS severity, 'completeness' AS category, 'user_positions' AS table_name,
           'position_continuity_check' AS check_name, count(*) AS count
    FROM (SELECT position_date AS d, lag(position_date) OVER (PARTITION BY user_id
                                                              ORDER BY position_date) AS p
          FROM (SELECT DISTINCT user_id, position_date FROM positions) x) y
    WHERE date_diff('day', p, d) > 7 HAVING count(*) > 0""")
def check_snapshot_gaps(m: Market):
    return figures(checks.snapshot_gaps(m.positions))


@query("check_gaps_per_user", "positions", sql="""
    SELECT 'warning' AS severity, 'completeness' AS category, 'user_positions' AS table_name,
           'position_gaps' AS check_name, count(*) AS count
    FROM (SELECT user_id, position_date AS d, lag(position_date) OVER (PARTITION BY user_id
                                                              ORDER BY position_date) AS p
          FROM (SELECT DISTINCT user_id, position_date FROM positions) x) y
    WHERE date_diff('day', p, d) > 7 GROUP BY user_id""")
def check_gaps_per_user(m: Market):
    return figures(checks.snapshot_gaps_per_user(m.positions))


@query("check_valuation_alignment", "bars_li", "valuation", "securities", sql="""
    SELECT 'warning' AS severity, 'completeness' AS category, 'valuation_data' AS table_name,
           'data_alignment_with_price' AS check_name, count(*) AS count
    FROM bars_li p JOIN securities s ON p.code = s.code AND p.day >= s.start_date
      AND (s.end_date IS NULL OR p.day <= s.end_date)
    WHERE p.day >= DATE '2001-08-01' - 30 AND NOT EXISTS (
      SELECT 1 FROM valuation v WHERE v.code = p.code AND v.day = p.day) HAVING count(*) >= 10""")
def check_valuation_alignment(m: Market):
    return figures(checks.alignment_with_price(m.bars_li, m.valuation, m.securities, "2001-08-01", 10))


@query("check_account_tables_on_dates", "ledger", "positions", "accounts", sql="""
    SELECT 'critical' AS severity, 'accuracy' AS category, 'user_positions' AS table_name,
           'position_logic_on_dates' AS check_name, count(*) AS count FROM positions
    WHERE position_date IN (DATE '1998-03-10', DATE '1998-03-13') AND (position_quantity < 0
      OR available_quantity < 0 OR available_quantity + frozen_quantity > position_quantity)
    HAVING count(*) > 0
    UNION ALL
    SELECT 'warning', 'accuracy', 'user_account_info', 'asset_balance_on_dates', count(*) FROM accounts
    WHERE info_date IN (DATE '1998-03-10', DATE '1998-03-13') AND total_assets > 0
      AND abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10
    HAVING count(*) > 0""")
def check_account_tables_on_dates(m: Market):
    return figures(checks.account_tables_on(["1998-03-10", "1998-03-13"], m.ledger, m.positions,
                                            m.accounts))


@query("check_load_rejects", "vendor_prices", sql="""
    SELECT 'warning' AS severity, 'accuracy' AS category, 'price_data' AS table_name,
           'negative_feed_value' AS check_name, CAST(1 AS BIGINT) AS count,
           ts_code || '@' || CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS samples
    FROM vendor_prices WHERE vol < 0 OR amount < 0""")
def check_load_rejects(m: Market):
    from quotemill.sources.landed import price_feed

    return flat(checks.load_rejects(price_feed(m.vendor_prices)))


@query("report_by_table", "ledger", "positions", "accounts", sql="""
    SELECT table_name, count(*) FILTER (severity = 'critical') AS critical,
           count(*) FILTER (severity = 'warning') AS warning,
           count(*) FILTER (severity = 'info') AS info
    FROM (SELECT 'user_positions' AS table_name, 'critical' AS severity FROM positions
          WHERE available_quantity > position_quantity OR position_quantity < 0 HAVING count(*) > 0
          UNION ALL SELECT 'user_positions', 'warning' FROM positions
          WHERE position_quantity > 0 AND market_value > 0 AND abs(position_quantity * current_price
                - market_value) / nullif(market_value, 0) > 0.05 HAVING count(*) > 0
          UNION ALL SELECT 'user_account_info', 'warning' FROM accounts WHERE total_assets > 0
            AND abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10
            AND info_date >= DATE '1995-06-01' HAVING count(*) > 0
          UNION ALL SELECT 'user_account_info', 'warning' FROM accounts
          WHERE total_assets < 0 OR position_market_value < 0 OR available_cash < 0
          HAVING count(*) > 0) x
    GROUP BY table_name""")
def report_by_table(m: Market):
    issues = judge_rows(m.positions, _rules("user_positions")).unionByName(
        judge_rows(m.accounts, _rules("user_account_info")))
    return report.by_table(issues)


@query("quality_report_totals", *VIEWS_OF_A_RUN, sql=f"""
    SELECT count(*) AS total_issues, count(*) FILTER (severity = 'critical') AS critical_issues,
           count(*) FILTER (severity = 'warning') AS warning_issues,
           count(DISTINCT table_name) AS tables_with_issues FROM ({run_sql(_THRESHOLDS, "standard")}) x""")
def quality_report_totals(m: Market):
    return report.totals(runner.run_checks(m.stored(), LEDGER_AS_OF, "standard",
                                           thresholds=_THRESHOLDS))


@query("quality_run_standard", *VIEWS_OF_A_RUN, sql=run_sql(_THRESHOLDS, "standard"))
def quality_run_standard(m: Market):
    """The whole standard rule set over seven tables."""
    return flat(runner.run_checks(m.stored(), LEDGER_AS_OF, "standard", thresholds=_THRESHOLDS))


@query("quality_routine", *VIEWS_OF_A_RUN, sql=routine_sql())
def quality_routine(m: Market):
    return flat(runner.routine(m.stored(), LEDGER_AS_OF))


@query("quality_top_issues", *VIEWS_OF_A_RUN, sql=f"""
    SELECT severity, category, table_name, check_name, count, samples
    FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY count DESC, table_name, check_name) AS rn
          FROM ({run_sql(_THRESHOLDS, "quick")}) x) y
    WHERE (severity = 'critical' AND rn <= 2) OR (severity = 'warning' AND rn <= 1)""")
def quality_top_issues(m: Market):
    return flat(report.top_issues(runner.run_checks(m.stored(), LEDGER_AS_OF, "quick",
                                                    thresholds=_THRESHOLDS)))


_RULE_FILE = {
    "global_config": {"check_levels": {"quick": {"sample_size": 40}, "standard": {"sample_size": 80}},
                      "thresholds": {"tolerance": 0.05}},
    "tables": {"user_transactions": {"enabled": True, "completeness_checks": [
        {"name": "no_rows", "severity": "critical",
         "sql": "SELECT count(*) AS count FROM user_transactions", "condition": "count > 0"},
        {"name": "needed", "severity": "critical", "fields": ["trade_id", "strategy_id"],
         "sql_template": "SELECT count(*) AS null_count FROM {table_name} WHERE {field} IS NULL",
         "threshold": 0},
        {"name": "listed", "severity": "warning", "fields": ["user_id", "strategy_id"],
         "sql_template": "SELECT trade_id, {field} FROM {table_name} WHERE {field} IS NULL"},
        {"name": "sold_share", "severity": "warning",
         "sql": "SELECT count_if(trade_type = 24) AS sold FROM user_transactions",
         "condition_template": "sold < {total_records} * 0.1"}],
        "uniqueness_checks": [
        {"name": "ids", "severity": "critical", "sql": "SELECT trade_id, COUNT(*) AS count FROM "
         "user_transactions GROUP BY trade_id HAVING COUNT(*) > 1"}],
        "accuracy_checks": [
        {"name": "few_big", "severity": "warning", "sql": "SELECT count(*) AS big FROM "
         "user_transactions WHERE quantity > 49", "condition": "big < 10"},
        {"name": "only_standard", "level": "standard", "sql": "SELECT 1 AS one"},
        {"name": "zero", "sql": "SELECT trade_id FROM user_transactions WHERE 1 / (quantity - quantity) > 0"},
        {"name": "broken", "sql": "SELECT no_such_column FROM user_transactions"}]}},
}


@query("rule_file_run", "ledger", sql="""
    SELECT 'warning' AS severity, 'completeness' AS category, 'user_transactions' AS table_name,
           'sold_share' AS check_name, count(*) FILTER (trade_type = 24) AS count, '' AS samples
    FROM ledger HAVING NOT count(*) FILTER (trade_type = 24) < count(*) * 0.1
    UNION ALL
    SELECT 'critical', 'uniqueness', 'user_transactions', 'ids', count(*),
           (SELECT string_agg('(' || trade_id || ')', ';' ORDER BY '(' || trade_id || ')') FROM (
              SELECT trade_id FROM ledger GROUP BY trade_id HAVING count(*) > 1
              ORDER BY '(' || trade_id || ')' LIMIT 5) t)
    FROM (SELECT trade_id FROM ledger GROUP BY trade_id HAVING count(*) > 1) x HAVING count(*) > 0
    UNION ALL
    SELECT 'warning', 'accuracy', 'user_transactions', 'few_big', count(*), '' FROM ledger
    WHERE quantity > 49 HAVING NOT count(*) < 10
    UNION ALL
    SELECT 'critical', 'accuracy', 'user_transactions', 'broken', CAST(0 AS BIGINT), ''
    UNION ALL
    SELECT 'critical', 'accuracy', 'user_transactions', 'zero', CAST(0 AS BIGINT), ''
    UNION ALL
    SELECT 'critical', 'completeness', 'user_transactions', 'needed_strategy_id', count(*), ''
    FROM ledger WHERE quantity < 3 HAVING count(*) > 0
    UNION ALL
    SELECT 'warning', 'completeness', 'user_transactions', 'listed_strategy_id', count(*), ''
    FROM ledger WHERE quantity < 3 HAVING count(*) > 0""")
def rule_file_run(m: Market):
    """NULLs stand in one asked field; one rule fails when read and one when run."""
    trades = m.ledger.withColumn("strategy_id", F.when(F.col("quantity") >= 3, F.lit("s")))
    return flat(sql_rules.run_rule_file(_RULE_FILE, {"user_transactions": trades}, LEDGER_AS_OF))
