"""Comparison texts of the whole quality runs: every check of a run over the seven tables, as one UNION ALL."""

from __future__ import annotations

from quotemill.functions.dates import HISTORY_START
from quotemill.plans.market import LEDGER_AS_OF
from quotemill.quality.rules import KEY_FIELDS, THRESHOLDS, UNIQUE_KEYS

_AS_OF = f"DATE '{LEDGER_AS_OF}'"
#: Table of a run -> (view, sample text of a row).
_SOURCES = {
    "stock_list": ("securities", "'(' || code || ')'"),
    "price_data": ("bars_li", "'(' || code || ', ' || day || ')'"),
    "valuation_data": ("valuation", "'(' || code || ', ' || day || ')'"),
    "indicator_data": ("indicators", "'(' || code || ', ' || \"statDate\" || ')'"),
    "user_transactions": ("ledger", "'(' || user_id || ', ' || trade_id || ', ' || stock_code || ')'"),
    "user_positions": ("positions", "'(' || user_id || ', ' || position_date || ', ' || stock_code || ')'"),
    "user_account_info": ("accounts", "'(' || user_id || ', ' || info_date || ')'"),
}
VIEWS_OF_A_RUN = [view for view, _ in _SOURCES.values()]


def _issue(severity: str, category: str, table: str, check: str, rest: str, count: str = "count(*)",
           samples: str = "''") -> str:
    return (f"SELECT '{severity}' AS severity, '{category}' AS category, '{table}' AS table_name, "
            f"'{check}' AS check_name, CAST({count} AS BIGINT) AS count, {samples} AS samples {rest}")


def _shown(rows: str, text: str, n: int = 5) -> str:
    return (f"(SELECT coalesce(string_agg(t, ';' ORDER BY t), '') FROM "
            f"(SELECT {text} AS t FROM {rows} ORDER BY 1 LIMIT {n}) s)")


def _listed(view: str, more: str = "true") -> str:
    return (f"(SELECT p.* FROM {view} p JOIN securities s ON p.code = s.code AND p.day >= s.start_date "
            f"AND (s.end_date IS NULL OR p.day <= s.end_date) WHERE {more})")


def _row_rules(t: dict, standard: bool) -> list[str]:
    tol, lim = t["financial_ratio_tolerance"], t["ratio_limit"]
    #: table, check, category, severity, bad, allowed, inside the listing life, standard level only, rows shown
    rules = [
        *[("stock_list", f"required_fields_not_null_{c}", "completeness", "critical", f"{c} IS NULL", 0, 0, 0, 0)
          for c in ("code", "display_name", "start_date")],
        ("stock_list", "stock_code_format", "accuracy", "critical", "right(code, 3) NOT IN ('.SH', '.SZ', '.BJ')", 0, 0, 0, 0),
        ("stock_list", "date_logic_validation", "accuracy", "critical", "end_date < start_date", 0, 0, 0, 0),
        ("stock_list", "exchange_code_validation", "accuracy", "warning", "exchange NOT IN ('XSHG', 'XSHE', 'BSE')", 0, 0, 0, 0),
        *[("price_data", f"required_fields_not_null_{c}", "completeness", "critical", f"{c} IS NULL", 0, 1, 0, 0)
          for c in ("code", "day", "open", "high", "low", "close", "volume")],
        ("price_data", "price_logic_validation", "accuracy", "critical",
         "high < low OR least(open, high, low, close, volume) < 0", 0, 1, 0, 1),
        ("price_data", "price_range_validation", "accuracy", "warning",
         "high > close * 1.15::DOUBLE OR low < close * 0.85::DOUBLE OR close > 1000 OR close < 0.01",
         t["max_extreme_prices"] - 1, 1, 0, 0),
        ("price_data", "price_bracket_validation", "accuracy", "warning",
         "high < greatest(open, close) OR low > least(open, close)", 0, 0, 1, 1),
        ("valuation_data", "valuation_ratios_reasonableness", "accuracy", "warning",
         "abs(pe_ratio) > 1000 OR pb_ratio < 0 OR pb_ratio > 100 OR market_cap < 0", t["max_extreme_valuations"] - 1, 1, 0, 0),
        ("indicator_data", "financial_ratios_validation", "accuracy", "warning",
         f"abs(eps) > 100 OR abs(roe) > {lim} OR abs(roa) > {lim}", t["max_invalid_ratios"] - 1, 0, 0, 0),
        *[("user_transactions", f"required_fields_completeness_{c}", "completeness", "critical", f"{c} IS NULL", 0, 0, 0, 0)
          for c in ("trade_id", "user_id", "stock_code", "trade_date", "trade_type")],
        ("user_transactions", "trade_type_validation", "accuracy", "critical", "trade_type NOT IN (23, 24)", 0, 0, 0, 1),
        ("user_transactions", "quantity_price_validation", "accuracy", "critical", "quantity <= 0 OR price <= 0", 0, 0, 0, 1),
        ("user_transactions", "amount_calculation_accuracy", "accuracy", "warning",
         f"quantity > 0 AND price > 0 AND amount > 0 AND abs(quantity * price - amount) / amount > {tol}", 0, 0, 0, 1),
        ("user_transactions", "trade_date_validation", "accuracy", "warning", f"trade_date > {_AS_OF}", 0, 0, 0, 1),
        ("user_positions", "position_quantity_logic", "accuracy", "critical",
         "position_quantity < 0 OR available_quantity < 0 OR frozen_quantity > position_quantity "
         "OR available_quantity + frozen_quantity > position_quantity", 0, 0, 0, 1),
        ("user_positions", "market_value_calculation", "accuracy", "warning",
         "position_quantity > 0 AND current_price > 0 AND market_value > 0 "
         f"AND abs(position_quantity * current_price - market_value) / market_value > {tol}", 0, 0, 0, 1),
        ("user_account_info", "asset_balance_check", "accuracy", "warning",
         "total_assets > 0 AND abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10 "
         f"AND info_date >= DATE '{t['user_data_start_date']}'", 0, 0, 0, 1),
        ("user_account_info", "negative_amounts_check", "accuracy", "warning",
         "least(total_assets, position_market_value, available_cash, frozen_cash) < 0", 0, 0, 0, 1),
    ]
    out = []
    for table, check, category, severity, bad, allowed, listed, only_standard, shown in rules:
        view, text = _SOURCES[table]
        source = f"{_listed(view) if listed else view} q WHERE ({bad})"
        if standard or not only_standard:
            out.append(_issue(severity, category, table, check, f"FROM {source} HAVING count(*) > {allowed}",
                              samples=_shown(source, text) if shown else "''"))
    return out


def _done(check_from: str) -> str:
    """Days expected and held per active security since history starts."""
    return f"""(SELECT s.code, count(DISTINCT c.day) AS expected, count(DISTINCT p.day) AS actual
        FROM (SELECT code, greatest(start_date, DATE '{HISTORY_START}') AS a,
                     least(coalesce(end_date, {_AS_OF}), (SELECT max(day) FROM bars_li WHERE day <= {_AS_OF})) AS b
              FROM securities WHERE end_date IS NULL OR end_date > {_AS_OF}) s
        JOIN (SELECT DISTINCT day FROM bars_li) c ON c.day BETWEEN a AND b
        LEFT JOIN bars_li p ON p.code = s.code AND p.day = c.day GROUP BY s.code) d {check_from}"""


def run_sql(thresholds: dict, level: str) -> str:
    t = {**THRESHOLDS, **thresholds}
    standard, since = level == "standard", f"DATE '{t['user_data_start_date']}'"
    parts = _row_rules(t, standard)
    for table, (view, _) in _SOURCES.items():
        parts.append(_issue("critical", "completeness", table, "table_not_empty", f"FROM {view} HAVING count(*) = 0", "1"))
        keys = ", ".join(f'"{k}"' for k in UNIQUE_KEYS[table])
        text = "'(' || " + " || ', ' || ".join(f'"{k}"' for k in UNIQUE_KEYS[table]) + " || ')'"
        groups = f"(SELECT {keys}, count(*) AS n FROM {view} GROUP BY {keys} HAVING count(*) > 1) g"
        parts.append(_issue("critical", "uniqueness", table, "primary_key_unique", f"FROM {groups} HAVING count(*) > 0",
                            "sum(n - 1)", _shown(groups, text, 10)))
        for c in KEY_FIELDS[table] if standard else ():
            for severity, over, up_to in (("critical", 0.3, 2), ("warning", 0.1, 0.3)):
                share = f'count(*) FILTER ("{c}" IS NULL)'
                parts.append(_issue(severity, "completeness", table, f"null_ratio_{c}", f"FROM {view} HAVING {share} > "
                                    f"{over} * count(*) AND {share} <= {up_to} * count(*)", share))
    parts.append(_issue("warning", "completeness", "stock_list", "active_stocks_coverage",
                        f"FROM securities WHERE (end_date IS NULL OR end_date > {_AS_OF}) AND status = 'normal' "
                        f"HAVING count(*) < {t['min_active_securities']}"))
    parts.append(_issue("warning", "completeness", "price_data", "recent_data_availability",
                        f"FROM bars_li WHERE day >= {_AS_OF} - 3 HAVING count(DISTINCT code) < {t['min_recent_codes']}",
                        "count(DISTINCT code)"))
    parts.append(_issue("warning", "completeness", "price_data", "time_series_completeness", "FROM " + _done(
        f"WHERE actual / expected < {t['completion_threshold']} HAVING count(*) > 0")))
    recent = _listed("bars_li", f"p.day >= {_AS_OF} - 30")
    if standard:
        for severity, bad in (("critical", "actual / expected < 0.8"),
                              ("warning", "actual / expected >= 0.8 AND actual / expected < 0.95")):
            parts.append(_issue(severity, "completeness", "price_data", "price_completeness",
                                "FROM " + _done(f"WHERE {bad}"), "expected - actual", "code"))
        short = "count(*) FILTER (actual / expected < 0.95)"
        parts.append(_issue("warning", "completeness", "price_data", "price_completeness_summary",
                            "FROM " + _done(f"HAVING {short} > 0.1 * count(*)"), short))
        moves = (f"(SELECT code, day, abs(close - prev) / prev AS r FROM (SELECT code, day, close, lag(close) OVER "
                 f"(PARTITION BY code ORDER BY day) AS prev FROM {recent} a) b WHERE prev > 0 "
                 f"AND abs(close - prev) / prev > {t['price_change_limit']}) m")
        parts.append(_issue("warning", "accuracy", "price_data", "abnormal_volatility",
                            f"FROM {moves} HAVING count(*) >= {t['max_volatile_moves']}", samples=_shown(
                                moves, "code || '@' || day || '(' || printf('%.2f', r * 100) || '%)'", 10)))
        caps = ("(SELECT p.code, p.day FROM bars_li p JOIN valuation v ON p.code = v.code AND p.day = v.day WHERE "
                "abs(v.market_cap * 1e8 - p.close * v.capitalization * 1e4) / nullif(abs(v.market_cap * 1e8), 0) > 0.05) m")
        parts.append(_issue("warning", "accuracy", "valuation_data", "market_cap", f"FROM {caps} HAVING count(*) > 0",
                            samples=_shown(caps, _SOURCES["price_data"][1])))
        held = ("(SELECT a.user_id, a.info_date FROM accounts a LEFT JOIN (SELECT user_id, position_date, sum(CAST("
                "market_value AS DECIMAL(38,10))) AS v FROM positions GROUP BY ALL) h ON a.user_id = h.user_id AND "
                "a.info_date = h.position_date WHERE abs(position_market_value - coalesce(v, 0)) > 10) m")
        parts.append(_issue("warning", "accuracy", "user_account_info", "account_value", f"FROM {held} HAVING count(*) > 0",
                            samples=_shown(held, _SOURCES["user_account_info"][1])))
    parts.append(_issue("warning", "completeness", "valuation_data", "data_alignment_with_price",
                        f"FROM {recent} p WHERE NOT EXISTS (SELECT 1 FROM valuation v WHERE v.code = p.code AND "
                        f"v.day = p.day) HAVING count(*) >= {t['max_missing_valuations']}"))
    parts.append(_issue("warning", "completeness", "indicator_data", "quarterly_data_completeness",
                        f"FROM indicators WHERE \"statDate\" >= date_trunc('quarter', {_AS_OF} - INTERVAL 3 MONTH) "
                        f"HAVING count(DISTINCT code) < {t['min_quarter_codes']}", "count(DISTINCT code)"))
    unknown = "ledger WHERE stock_code NOT IN (SELECT code FROM securities)"
    parts.append(_issue("warning", "completeness", "user_transactions", "stock_code_reference_integrity",
                        f"FROM {unknown} HAVING count(*) > 0",
                        samples=_shown(f"(SELECT DISTINCT stock_code FROM {unknown}) d", "stock_code")))
    for table, day, check, severity in (
            ("user_transactions", "trade_date", "non_trading_day_transactions", "critical"),
            ("user_positions", "position_date", "non_trading_day_check", "warning"),
            ("user_account_info", "info_date", "non_trading_day_check", "warning")):
        closed = f"{_SOURCES[table][0]} WHERE {day} >= {since} AND {day} NOT IN (SELECT day FROM bars_li)"
        parts.append(_issue(severity, "completeness", table, check, f"FROM {closed} HAVING count(*) > 0",
                            samples=_shown(f"(SELECT DISTINCT {day} FROM {closed}) d", f"CAST({day} AS VARCHAR)")))
    for table, day in (("user_positions", "position_date"), ("user_account_info", "info_date")):
        view = _SOURCES[table][0]
        gone = (f"(SELECT DISTINCT day FROM bars_li WHERE day >= {since} AND day <= (SELECT max({day}) FROM {view}) "
                f"AND day NOT IN (SELECT {day} FROM {view})) d")
        parts.append(_issue("warning", "completeness", table, "trading_day_completeness",
                            f"FROM {gone} HAVING count(*) > 0", samples=_shown(gone, "CAST(day AS VARCHAR)")))
    gaps = ("(SELECT user_id, d, p FROM (SELECT user_id, position_date AS d, lag(position_date) OVER (PARTITION BY user_id "
            "ORDER BY position_date) AS p FROM (SELECT DISTINCT user_id, position_date FROM positions) x) y "
            f"WHERE d - p > {t['max_gap_days']}) z")
    parts.append(_issue("warning", "completeness", "user_positions", "position_continuity_check",
                        f"FROM {gaps} HAVING count(*) > 0",
                        samples=_shown(gaps, "'(' || user_id || ', ' || d || ', ' || p || ', ' || (d - p) || ')'")))
    return "\nUNION ALL ".join(parts)


_ROUTINE_DAYS = f"""
    past AS (SELECT DISTINCT day FROM bars_li WHERE day < {_AS_OF}),
    edge AS (SELECT min(day) AS e FROM (SELECT day FROM past ORDER BY day DESC LIMIT 8) x),
    newest AS (SELECT day FROM past ORDER BY day DESC LIMIT 3),
    chosen AS (SELECT day FROM newest UNION SELECT day FROM (
        SELECT day FROM past, edge WHERE day BETWEEN e - 365 AND e
        ORDER BY md5(CAST(day AS VARCHAR) || '0'), day LIMIT 30) y),
    due AS (SELECT s.code, c.day FROM securities s JOIN chosen c ON s.start_date <= c.day
            AND (s.end_date IS NULL OR s.end_date > c.day)),
    cover AS (SELECT d.day, count(*) AS expected, any_value(a.n) AS actual FROM due d LEFT JOIN
              (SELECT day, count(DISTINCT code) AS n FROM bars_li GROUP BY day) a ON a.day = d.day GROUP BY d.day),
    absent AS (SELECT d.day, d.code, row_number() OVER (PARTITION BY d.day ORDER BY d.code) AS k FROM due d
               WHERE NOT EXISTS (SELECT 1 FROM bars_li p WHERE p.code = d.code AND p.day = d.day)),
    priced AS (SELECT code, day FROM bars_li WHERE code NOT LIKE '%.BJ' AND day IN (SELECT day FROM chosen)),
    bare AS (SELECT p.day, p.code, row_number() OVER (PARTITION BY p.day ORDER BY p.code) AS k FROM priced p
             WHERE NOT EXISTS (SELECT 1 FROM valuation v WHERE v.code = p.code AND v.day = p.day)),
    part AS (SELECT t.day, t.total, b.n FROM (SELECT day, count(*) AS total FROM priced GROUP BY day) t
             JOIN (SELECT day, count(*) AS n FROM bare GROUP BY day) b ON t.day = b.day),
    r AS (SELECT * FROM indicators WHERE code NOT LIKE '%.BJ' AND "statDate" >= DATE '2000-01-01'),
    q AS (SELECT "statDate" AS d, count(*) AS n FROM r GROUP BY 1),
    e(d) AS (VALUES (DATE '2001-12-31'), (DATE '2001-09-30'), (DATE '2001-06-30'), (DATE '2001-03-31')),
    report AS (SELECT count(*) AS expected, (SELECT count(DISTINCT code) FROM indicators
               WHERE "statDate" = DATE '2001-12-31') AS actual FROM due WHERE day = (SELECT max(day) FROM newest))"""


def routine_sql() -> str:
    """The quarter due on any day of November 2001 is that year's last, as the dates of the run are fixed."""
    wrong = " OR ".join(["high < low", *[f"{c} < 0" for c in ("open", "close", "high", "low", "volume")]])
    parts = [
        "SELECT CASE WHEN 1 - actual / expected > 0.2 THEN 'critical' ELSE 'warning' END AS severity, 'completeness' AS category, "
        "'price_data' AS table_name, 'price_day_coverage' AS check_name, expected - actual AS count, coalesce((SELECT "
        "string_agg(code, ';' ORDER BY code) FROM absent a WHERE a.day = f.day AND k <= 5), '') AS samples "
        "FROM (SELECT day, expected, coalesce(actual, 0) AS actual FROM cover) f WHERE actual < expected * 0.95",
        "SELECT 'critical', 'accuracy', 'price_data', 'price_day_logic', count(*), '' FROM bars_li "
        f"WHERE day IN (SELECT day FROM chosen) AND ({wrong}) GROUP BY day",
        "SELECT CASE WHEN n / total > 0.5 THEN 'critical' ELSE 'warning' END, 'completeness', 'valuation_data', "
        "'valuation_data_day_coverage', n, (SELECT string_agg(code, ';' ORDER BY code) FROM bare b WHERE b.day = f.day "
        "AND k <= 5) FROM part f WHERE n / total > 0.1",
        "SELECT CASE WHEN 1 - actual / expected > 0.5 THEN 'critical' ELSE 'warning' END, 'completeness', 'indicator_data', "
        "'report_coverage', expected - actual, '' FROM report WHERE 1 - actual / expected > 0.3",
        f"SELECT 'warning', 'completeness', 'indicator_data', 'quarter_stale', 1, '' FROM q HAVING max(d) < {_AS_OF} - 180",
        "SELECT 'warning', 'completeness', 'indicator_data', 'quarters_missing', count(*), string_agg(CAST(d AS VARCHAR), ';' "
        "ORDER BY d) FROM e WHERE d NOT IN (SELECT d FROM q) HAVING count(*) > 0",
        "SELECT 'warning', 'completeness', 'indicator_data', 'quarter_thin', n, '' FROM e JOIN q ON e.d = q.d "
        f"WHERE n < {THRESHOLDS['min_quarter_rows']}",
        *[f"SELECT 'warning', 'accuracy', 'indicator_data', 'mostly_null_{c}', count(*) FILTER ({c} IS NULL), '' FROM r "
          f"HAVING count(*) FILTER ({c} IS NULL) > 0.5 * count(*)" for c in ("eps", "roe")],
    ]
    for table, view, day, check, severity, bad, may_be_empty in (
            ("user_positions", "positions", "position_date", "position_logic_on_dates", "critical",
             "position_quantity < 0 OR available_quantity < 0 OR frozen_quantity > position_quantity "
             "OR available_quantity + frozen_quantity > position_quantity", False),
            ("user_account_info", "accounts", "info_date", "asset_balance_on_dates", "warning", "total_assets > 0 AND "
             "abs(total_assets - (position_market_value + available_cash + frozen_cash)) > 10", False),
            ("user_transactions", "ledger", "trade_date", "trade_logic_on_dates", "critical",
             "quantity <= 0 OR price <= 0 OR trade_type NOT IN (23, 24)", True)):
        there = f"FROM {view} WHERE {day} IN (SELECT day FROM chosen)"
        parts.append(f"SELECT '{severity}', 'accuracy', '{table}', '{check}', count(*), '' {there} AND ({bad}) HAVING count(*) > 0")
        if not may_be_empty:
            parts.append(f"SELECT 'warning', 'completeness', '{table}', 'no_rows_on_dates', 0, '' {there} HAVING count(*) = 0")
    return f"WITH {_ROUTINE_DAYS}\n" + "\nUNION ALL ".join(parts)
