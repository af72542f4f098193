"""Counts, latest dates, coverage, anti joins and uniqueness."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import coverage as cov
from quotemill.operators import day_maps, scan
from quotemill.plans.market import EVENTS_AS_OF, LEDGER_AS_OF, Market
from quotemill.plans.registry import query


@query("securities_by_market", "securities", sql="""
    SELECT exchange, market, count(*) AS n, exchange || '_' || market AS label FROM securities
    WHERE status = 'normal' AND end_date IS NULL GROUP BY exchange, market""")
def securities_by_market(m: Market):
    return cov.securities_by_market(m.securities)


@query("securities_by_suffix", "securities", sql="""
    SELECT right(code, 2) AS suffix, count(*) AS n FROM securities GROUP BY 1 ORDER BY n DESC""")
def securities_by_suffix(m: Market):
    return cov.count_by(m.securities, cov.suffix_bucket().alias("suffix")).orderBy(F.desc("n"))


@query("end_date_categories", "securities", sql="""
    SELECT CASE WHEN end_date IS NULL THEN 'null' WHEN end_date > DATE '2000-06-30' THEN 'future'
                ELSE 'past' END AS category, count(*) AS n FROM securities GROUP BY 1""")
def end_date_categories(m: Market):
    return cov.count_by(m.securities, cov.end_date_category("2000-06-30").alias("category"))


@query("price_coverage_total", "bars_li", sql="""
    SELECT count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM bars_li""")
def price_coverage_total(m: Market):
    return cov.price_coverage(m.bars_li)


@query("price_coverage_by_code", "bars_li", sql="""
    SELECT code, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day
    FROM bars_li GROUP BY code""")
def price_coverage_by_code(m: Market):
    return cov.price_coverage(m.bars_li, "code")


@query("latest_dates_per_code", "bars_ev", "securities", sql="""
    SELECT s.code, x.max_date FROM (SELECT DISTINCT code FROM securities) s
    LEFT JOIN (SELECT code, max(day) AS max_date FROM bars_ev GROUP BY code) x ON s.code = x.code""")
def latest_dates_per_code(m: Market):
    return cov.latest_dates(m.bars_ev, m.securities)


@query("latest_dates_all_tables", "bars_li", "valuation", "indicators", "statements", sql="""
    SELECT 'price_data' AS table_name, max(day) AS max_date FROM bars_li
    UNION ALL SELECT 'valuation_data', max(day) FROM valuation
    UNION ALL SELECT 'indicator_data', max("pubDate") FROM indicators
    UNION ALL SELECT 'income_statement', max(stat_date) FROM statements""")
def latest_dates_all_tables(m: Market):
    from quotemill.schemas import WATERMARK

    tables = {"price_data": m.bars_li, "valuation_data": m.valuation,
              "indicator_data": m.indicators, "income_statement": m.statements}
    parts = [cov.latest_date(df, WATERMARK[t]).select(F.lit(t).alias("table_name"), "max_date")
             for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("existing_codes", "bars_ev", sql="SELECT DISTINCT code FROM bars_ev ORDER BY code")
def existing_codes(m: Market):
    return cov.existing_codes(m.bars_ev)


@query("duplicate_trade_ids", "ledger", sql="""
    SELECT trade_id, count(*) AS n FROM ledger GROUP BY trade_id HAVING count(*) > 1""")
def duplicate_trade_ids(m: Market):
    return cov.duplicate_keys(m.ledger, ["trade_id"])


@query("duplicate_surplus", "ledger", sql="""
    SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
    FROM (SELECT trade_id, count(*) AS n FROM ledger GROUP BY trade_id HAVING count(*) > 1) x""")
def duplicate_surplus(m: Market):
    return cov.duplicate_surplus(m.ledger, ["trade_id"])


@query("null_counts", "indicators", sql="""
    SELECT * FROM (SELECT 'eps' AS column_name, count(*) FILTER (eps IS NULL) AS null_count,
                          count(*) AS total FROM indicators
                   UNION ALL SELECT 'roe', count(*) FILTER (roe IS NULL), count(*) FROM indicators
                   UNION ALL SELECT 'code', count(*) FILTER (code IS NULL), count(*)
                   FROM indicators) x""")
def null_counts(m: Market):
    return cov.null_counts(m.indicators, ["eps", "roe", "code"])


_LOADED = """(SELECT s.code, coalesce(n, 0) AS records_count,
                     CASE WHEN coalesce(n, 0) > 0 THEN 'successful' ELSE 'failed' END AS status
              FROM (SELECT code FROM securities) s
              LEFT JOIN (SELECT code, count(*) AS n FROM bars_ev WHERE day >= DATE '2024-01-29'
                         GROUP BY code) x ON s.code = x.code)"""


@query("loaded_per_code", "securities", "bars_ev", sql=f"SELECT * FROM {_LOADED} y")
def loaded_per_code(m: Market):
    return cov.loaded_per_code(m.bars_ev.filter("day >= DATE '2024-01-29'"), m.securities)


@query("load_summary", "securities", "bars_ev", sql=f"""
    SELECT count(*) AS total, count(*) FILTER (status = 'successful') AS successful,
           count(*) FILTER (status = 'failed') AS failed, CAST(sum(records_count) AS BIGINT) AS records,
           round(count(*) FILTER (status = 'successful') / count(*), 6) AS success_rate
    FROM {_LOADED} y""")
def load_summary(m: Market):
    return cov.load_summary(
        cov.loaded_per_code(m.bars_ev.filter("day >= DATE '2024-01-29'"), m.securities))


@query("codes_with_recent_data", "bars_ev", sql="""
    SELECT count(DISTINCT code) AS n_codes FROM bars_ev WHERE day >= DATE '2024-01-27'""")
def codes_with_recent_data(m: Market):
    return cov.codes_with_recent_data(m.bars_ev, "2024-01-27")


@query("rows_on_dates", "ledger", sql="""
    SELECT trade_date, count(*) AS n FROM ledger
    WHERE trade_date IN (DATE '1998-03-10', DATE '1998-03-11', DATE '1999-05-03') GROUP BY trade_date""")
def rows_on_dates(m: Market):
    return cov.rows_on_dates(m.ledger, ["1998-03-10", "1998-03-11", "1999-05-03"], "trade_date")


@query("reports_per_quarter", "indicators", sql="""
    SELECT "statDate", count(*) AS n FROM indicators WHERE "statDate" >= DATE '1997-01-01'
      AND strftime("statDate", '%m-%d') IN ('03-31', '06-30', '09-30', '12-31')
    GROUP BY "statDate" ORDER BY "statDate" DESC""")
def reports_per_quarter(m: Market):
    return cov.reports_per_quarter(m.indicators, "1997-01-01")


@query("missing_quarters", "indicators", sql="""
    SELECT quarter FROM (VALUES (DATE '2001-12-31'), (DATE '2001-09-30'), (DATE '2001-06-30'),
                                (DATE '2001-03-31')) v(quarter)
    WHERE quarter NOT IN (SELECT "statDate" FROM indicators)""")
def missing_quarters(m: Market):
    return cov.missing_quarters(m.indicators, "2001-12-15")


@query("within_listing", "bars_li", "securities", sql="""
    SELECT p.code, p.day, p.close FROM bars_li p JOIN securities s ON p.code = s.code
      AND p.day >= s.start_date AND (s.end_date IS NULL OR p.day <= s.end_date)""")
def within_listing(m: Market):
    return cov.within_listing(m.bars_li, m.securities).select("code", "day", "close")


@query("unknown_codes", "bars_ev", "securities", sql="""
    SELECT code, count(*) AS n FROM bars_ev WHERE code NOT IN (SELECT code FROM securities)
    GROUP BY code""")
def unknown_codes(m: Market):
    return cov.unknown_codes(m.bars_ev, m.securities, "code")


@query("rows_with_unknown_code", "bars_ev", "securities", sql="""
    SELECT code, day, close FROM bars_ev WHERE code NOT IN (SELECT code FROM securities)""")
def rows_with_unknown_code(m: Market):
    return cov.rows_with_unknown_code(m.bars_ev, m.securities, "code").select("code", "day", "close")


@query("prices_without_valuation", "bars_li", "valuation", sql="""
    SELECT code, day FROM bars_li p WHERE code NOT LIKE '%.BJ' AND NOT EXISTS (
      SELECT 1 FROM valuation v WHERE v.code = p.code AND v.day = p.day)""")
def prices_without_valuation(m: Market):
    return cov.prices_without(m.bars_li, m.valuation)


@query("prices_without_indicator", "bars_li", "indicators", sql="""
    SELECT code, day FROM bars_li p WHERE NOT EXISTS (
      SELECT 1 FROM indicators i WHERE i.code = p.code AND i."statDate" = p.day)""")
def prices_without_indicator(m: Market):
    return cov.prices_without(m.bars_li, m.indicators, "statDate", skip_suffix=None)


@query("missing_on_days", "bars_ev", "securities", sql="""
    SELECT s.code, d.day FROM securities s, (VALUES (DATE '2024-01-10'), (DATE '2024-01-20'),
                                                   (DATE '2024-01-30')) d(day)
    WHERE s.start_date <= d.day AND (s.end_date IS NULL OR s.end_date > d.day)
      AND NOT EXISTS (SELECT 1 FROM bars_ev p WHERE p.code = s.code AND p.day = d.day)""")
def missing_on_days(m: Market):
    return cov.missing_on_days(m.securities, m.bars_ev, ["2024-01-10", "2024-01-20", "2024-01-30"])


@query("missing_trading_days", "bars_li", "securities", sql="""
    SELECT s.code, d.day FROM securities s JOIN (SELECT DISTINCT day FROM bars_li) d
      ON s.start_date <= d.day AND (s.end_date IS NULL OR s.end_date > d.day)
    WHERE NOT EXISTS (SELECT 1 FROM bars_li p WHERE p.code = s.code AND p.day = d.day)""")
def missing_trading_days(m: Market):
    return cov.missing_trading_days(m.securities, m.bars_li)


@query("day_coverage", "bars_li", "securities", sql="""
    SELECT d.day, (SELECT count(*) FROM securities s WHERE s.start_date <= d.day
                     AND (s.end_date IS NULL OR s.end_date > d.day)) AS expected, d.actual
    FROM (SELECT day, count(DISTINCT code) AS actual FROM bars_li GROUP BY day) d""")
def day_coverage(m: Market):
    return cov.day_coverage(m.securities, m.bars_li)


@query("series_completeness", "bars_li", "securities", sql=f"""
    WITH cal AS (SELECT DISTINCT day FROM bars_li),
         spans AS (SELECT code, greatest(start_date, DATE '1996-01-01') AS from_day,
                          least(coalesce(end_date, l.d), l.d) AS to_day
                   FROM securities, (SELECT max(day) AS d FROM cal WHERE day <= DATE '{LEDGER_AS_OF}') l),
         expected AS (SELECT s.code, count(c.day) AS expected_days FROM spans s
                      LEFT JOIN cal c ON c.day BETWEEN s.from_day AND s.to_day GROUP BY s.code),
         held AS (SELECT s.code, count(p.day) AS actual_days FROM spans s
                  LEFT JOIN bars_li p ON p.code = s.code AND p.day BETWEEN s.from_day AND s.to_day
                  GROUP BY s.code)
    SELECT s.code, s.from_day, s.to_day, e.expected_days, h.actual_days,
           round(CASE WHEN e.expected_days = 0 THEN 1.0
                      ELSE least(1.0, h.actual_days / e.expected_days) END, 6) AS completeness
    FROM spans s JOIN expected e ON s.code = e.code JOIN held h ON s.code = h.code""")
def series_completeness(m: Market):
    import datetime as dt

    return cov.completeness(m.securities, m.bars_li, None, LEDGER_AS_OF, floor=dt.date(1996, 1, 1))


@query("day_maps_of_loads", "bars_li", sql="""
    SELECT code, count(DISTINCT day) AS n_days, count(DISTINCT day) FILTER (year(day) = 1998) AS n_1998,
           max(day) AS last_day FROM bars_li GROUP BY code""")
def day_maps_of_loads(m: Market):
    """Bitmaps of three loads, two of which share days, merged; counted without opening them."""
    loads = [m.bars_li.filter(c) for c in ("day < '1995-07-01'", "day BETWEEN '1995-01-01' AND '1998-03-15'",
                                           "day >= '1998-03-16'")]
    maps = day_maps.merged(*[day_maps.day_maps(x) for x in loads])
    first, last = F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")
    inside = F.col("bits").bitwiseAND(day_maps.span_mask(F.col("word"), first, last))
    words = F.collect_list(F.struct("word", "bits"))
    return maps.groupBy("code").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_days"),
        F.sum(F.bit_count(inside)).cast("bigint").alias("n_1998"),
        day_maps.newest_day(words, F.lit("9999-12-31").cast("date")).alias("last_day"))


@query("incomplete_indices", "bars_li", "securities", sql="""
    SELECT code, n_rows, first_day, reason FROM (
      SELECT s.code, coalesce(x.n, 0) AS n_rows, x.first_day,
             CASE WHEN coalesce(x.n, 0) = 0 THEN 'empty'
                  WHEN x.n < floor(date_diff('day', DATE '1995-01-01', DATE '1998-06-30')
                                   * 245 / 365 * 0.8) THEN 'short'
                  WHEN x.first_day > DATE '1995-01-01' + 60 THEN 'late' END AS reason
      FROM (SELECT DISTINCT code FROM securities) s
      LEFT JOIN (SELECT code, count(*) AS n, min(day) AS first_day FROM bars_li
                 WHERE day >= DATE '1995-04-01' OR code LIKE '%1.SZ' GROUP BY code) x
        ON s.code = x.code) y
    WHERE reason IS NOT NULL""")
def incomplete_indices(m: Market):
    """Most codes start in April, so that late first bars occur."""
    bars = m.bars_li.filter("day >= DATE '1995-04-01' OR code LIKE '%1.SZ'")
    return cov.incomplete_indices(bars, m.securities, "1995-01-01", "1998-06-30")


@query("code_names_with_default", "bars_ev", "securities", sql="""
    SELECT c.code, coalesce(s.name, c.code) AS name, coalesce(s.display_name, c.code) AS display_name,
           s.exchange, s.market
    FROM (SELECT DISTINCT code FROM bars_ev) c LEFT JOIN securities s ON c.code = s.code""")
def code_names_with_default(m: Market):
    return cov.with_master_names(m.bars_ev, m.securities)


@query("catalog", "bars_li", "valuation", "ledger", sql="""
    SELECT 'price_data' AS table_name, count(*) AS record_count, 7 AS n_columns FROM bars_li
    UNION ALL SELECT 'valuation_data', count(*), 6 FROM valuation
    UNION ALL SELECT 'user_transactions', count(*), 14 FROM ledger""")
def catalog(m: Market):
    return cov.catalog({"price_data": m.bars_li, "valuation_data": m.valuation,
                        "user_transactions": m.ledger})


@query("active_count", "securities", sql="""
    SELECT count(*) AS active_count FROM securities
    WHERE (end_date IS NULL OR end_date > DATE '2000-07-01') AND status = 'normal'""")
def active_count(m: Market):
    return cov.active_count(m.securities, "2000-07-01")


@query("codes_only_in_prices", "bars_ev", "bars_li", sql="""
    SELECT code FROM bars_ev EXCEPT SELECT code FROM bars_li""")
def codes_only_in_prices(m: Market):
    return m.bars_ev.select("code").distinct().join(m.bars_li.select("code"), "code", "left_anti")
