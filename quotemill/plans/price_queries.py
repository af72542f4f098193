"""Price series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions.values import pad_change
from quotemill.operators import calendar as cal
from quotemill.operators import scan, series
from quotemill.plans.market import EVENTS_AS_OF, LEDGER_AS_OF, Market, _code, code_from, query_round as r6
from quotemill.plans.registry import query

_ADJ = "SELECT *, close * factor AS adj_close FROM bars_ev"


@query("daily_returns", "bars_ev", sql=f"""
    SELECT code, day, close, adj_close, round(adj_close / nullif(prev, 0) - 1.0, 6) AS "return"
    FROM (SELECT *, lag(adj_close) OVER (PARTITION BY code ORDER BY day) AS prev
          FROM ({_ADJ}) a) b""")
def daily_returns(m: Market):
    return r6(series.daily_returns(m.bars_ev), "return")


@query("daily_returns_padded_gaps", "bars_ev", sql=f"""
    SELECT code, day, adj_close, round(filled / nullif(before, 0) - 1.0, 6) AS "return"
    FROM (SELECT *, last_value(adj_close IGNORE NULLS) OVER (
                      PARTITION BY code ORDER BY day ROWS UNBOUNDED PRECEDING) AS filled,
                    last_value(adj_close IGNORE NULLS) OVER (
                      PARTITION BY code ORDER BY day
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM (SELECT code, day, CASE WHEN day(day) % 5 <> 0 THEN close * factor END AS adj_close
                FROM bars_ev) a) b""")
def daily_returns_padded_gaps(m: Market):
    holes = m.bars_ev.select("code", "day", F.when(
        F.day("day") % 5 != 0, F.col("close") * F.col("factor")).alias("adj_close"))
    out = holes.withColumn("return", pad_change(F.col("adj_close"), series.by_day()))
    return r6(out, "return")


@query("daily_returns_unpadded", "bars_ev", sql="""
    SELECT code, day, adj_close, round(adj_close / nullif(prev, 0) - 1.0, 6) AS "return"
    FROM (SELECT *, lag(adj_close) OVER (PARTITION BY code ORDER BY day) AS prev
          FROM (SELECT code, day, CASE WHEN day(day) % 5 <> 0 THEN close * factor END AS adj_close
                FROM bars_ev) a) b""")
def daily_returns_unpadded(m: Market):
    holes = m.bars_ev.select("code", "day", F.when(
        F.day("day") % 5 != 0, F.col("close") * F.col("factor")).alias("adj_close"))
    out = holes.withColumn("return", pad_change(F.col("adj_close"), series.by_day(), pad=False))
    return r6(out, "return")


_VOL = """
    WITH rets AS (SELECT code, day, close, adj_close / nullif(lag(adj_close) OVER (
                      PARTITION BY code ORDER BY day), 0) - 1.0 AS ret
                  FROM ({adj}) a)
    SELECT code, day, close, round(ret, 6) AS "return",
           round(CASE WHEN count(ret) OVER w >= {n}
                      THEN stddev_samp(ret) OVER w * sqrt(252.0::DOUBLE) END, 6) AS volatility
    FROM rets WINDOW w AS (PARTITION BY code ORDER BY day ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"""


@query("rolling_volatility_20", "bars_ev", sql=_VOL.format(adj=_ADJ, n=20, k=19))
def rolling_volatility_20(m: Market):
    return r6(series.volatility(m.bars_ev), "return", "volatility")


@query("rolling_volatility_20_sparse", "bars_li", sql=_VOL.format(
    adj="SELECT *, close AS adj_close FROM bars_li", n=20, k=19))
def rolling_volatility_20_sparse(m: Market):
    return r6(series.volatility(m.bars_li, adjust="none"), "return", "volatility")


def _ma_sql(view: str, as_of: str) -> str:
    cols = ", ".join(
        f"CASE WHEN count(CASE WHEN n <= {p} THEN close END) = {p} THEN round("
        f"CAST(CAST(sum(CASE WHEN n <= {p} THEN CAST(close AS DECIMAL(38,10)) END) AS DECIMAL(38,4)) AS DOUBLE) / {p}.0::DOUBLE, 2) END AS ma{p}"
        for p in series.MA_PERIODS)
    return f"""SELECT code, DATE '{as_of}' AS date, {cols}
        FROM (SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n
              FROM {view} WHERE day <= DATE '{as_of}' AND day >= DATE '{as_of}' - 500) x
        WHERE n <= 250 GROUP BY code"""


@query("moving_averages", "bars_ev", sql=_ma_sql("bars_ev", EVENTS_AS_OF))
def moving_averages(m: Market):
    return series.moving_averages(m.bars_ev, EVENTS_AS_OF)


@query("moving_averages_long", "bars_li", sql=_ma_sql("bars_li", LEDGER_AS_OF))
def moving_averages_long(m: Market):
    return series.moving_averages(m.bars_li, LEDGER_AS_OF)


_PERIOD = """
    WITH last_px AS (SELECT code, {label} AS p, max_by(close, day) AS px FROM {view} GROUP BY 1, 2),
         span AS (SELECT code, min(p) AS a, max(p) AS b FROM last_px GROUP BY code),
         spine AS (SELECT code, {to_label} AS p FROM (
                     SELECT code, unnest(generate_series({a}, {b}, INTERVAL {step})) AS g
                     FROM span) s),
         filled AS (SELECT spine.code, spine.p, last_px.px,
                      last_value(px IGNORE NULLS) OVER (PARTITION BY spine.code ORDER BY spine.p
                        ROWS UNBOUNDED PRECEDING) AS cur,
                      last_value(px IGNORE NULLS) OVER (PARTITION BY spine.code ORDER BY spine.p
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                    FROM spine LEFT JOIN last_px ON spine.code = last_px.code AND spine.p = last_px.p)
    SELECT code, p AS day, px AS adj_close, round(cur / nullif(before, 0) - 1.0, 6) AS "return"
    FROM filled"""


@query("weekly_returns", "bars_li", sql=_PERIOD.format(
    view="bars_li", label="CAST(date_trunc('week', day) AS DATE) + 6", a="a", b="b",
    step="7 DAY", to_label="CAST(g AS DATE)"))
def weekly_returns(m: Market):
    return r6(series.weekly_returns(m.bars_li, adjust="none"), "return")


@query("monthly_returns", "bars_li", sql=_PERIOD.format(
    view="bars_li", label="last_day(day)", a="CAST(date_trunc('month', a) AS DATE)",
    b="CAST(date_trunc('month', b) AS DATE)", step="1 MONTH", to_label="last_day(CAST(g AS DATE))"))
def monthly_returns(m: Market):
    return r6(series.monthly_returns(m.bars_li, adjust="none"), "return")


@query("price_range_252", "bars_ev", sql=f"""
    SELECT code, 252 AS period_days, min(day) AS start_date, max(day) AS end_date,
           max(high) AS highest, min(low) AS lowest, max_by(close, day) AS latest_close,
           round(CAST(CAST(sum(CAST(close AS DECIMAL(38,10))) AS DECIMAL(38,4)) AS DOUBLE) / count(close), 6) AS avg_price,
           round((max_by(close, day) - min(low)) / nullif(max(high) - min(low), 0) * 100.0, 6)
               AS position_pct
    FROM bars_ev WHERE day BETWEEN DATE '{EVENTS_AS_OF}' - 252 AND DATE '{EVENTS_AS_OF}'
    GROUP BY code""")
def price_range_252(m: Market):
    return r6(series.price_range(m.bars_ev, EVENTS_AS_OF), "avg_price", "position_pct")


@query("latest_price", "bars_li", sql="""
    SELECT code, day, open, high, low, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM bars_li) x
    WHERE n = 1""")
def latest_price(m: Market):
    return series.latest_rows(m.bars_li)


@query("latest_10_rows_per_code", "bars_li", sql="""
    SELECT code, day, open, high, low, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM bars_li) x
    WHERE n <= 10""")
def latest_10_rows_per_code(m: Market):
    return series.latest_rows(m.bars_li, n=10)


_MOVES = """
    SELECT code, day, close, prev_close, round(change_ratio, 6) AS change_ratio
    FROM (SELECT code, day, close, prev_close,
                 abs(close - prev_close) / nullif(prev_close, 0) AS change_ratio
          FROM (SELECT code, day, close,
                       lag(close) OVER (PARTITION BY code ORDER BY day) AS prev_close
                FROM {view} {where}) x) y
    WHERE prev_close > 0 AND change_ratio > 0.5"""


@query("abnormal_moves_30d", "bars_ev", sql=_MOVES.format(
    view="bars_ev", where=f"WHERE day >= DATE '{EVENTS_AS_OF}' - 30"))
def abnormal_moves_30d(m: Market):
    return r6(series.abnormal_moves(m.bars_ev, EVENTS_AS_OF), "change_ratio")


@query("abnormal_moves_all", "bars_li", sql=_MOVES.format(view="bars_li", where=""))
def abnormal_moves_all(m: Market):
    return r6(series.abnormal_moves(m.bars_li, LEDGER_AS_OF, days=None), "change_ratio")


# Ticks as they come, half of them without a code: one key of half of all rows.
_DIRTY = f"""
    SELECT code, day, close, copies, lag(close) OVER (PARTITION BY code ORDER BY day NULLS FIRST, close NULLS FIRST) AS prev_close
    FROM (SELECT CASE WHEN user_id % 2 = 1 THEN {_code('user_id')} END AS code, CAST(ts AS DATE) AS day, value AS close,
                 count(*) AS copies FROM events GROUP BY ALL) x"""


def _dirty_rows(m: Market):
    return m.raw("events").select(F.when(F.col("user_id") % 2 == 1, code_from(F.col("user_id"))).alias("code"),
                                  F.to_date("ts").alias("day"), F.col("value").alias("close"))


@query("day_changes_dirty", sql=f"""
    SELECT code, day, close, copies, prev_close, round(close / nullif(prev_close, 0) - 1.0, 6) AS "return" FROM ({_DIRTY}) y""")
def day_changes_dirty(m: Market):
    return r6(series.day_changes(_dirty_rows(m)), "return")


@query("abnormal_moves_dirty", sql=f"""
    SELECT code, day, close, prev_close, round(abs(close / prev_close - 1.0), 6) AS change_ratio FROM ({_DIRTY}) y
    WHERE prev_close > 0 AND abs(close / prev_close - 1.0) > 0.5""")
def abnormal_moves_dirty(m: Market):
    return r6(series.abnormal_moves_of_dirty_rows(_dirty_rows(m), EVENTS_AS_OF, days=None), "change_ratio")


@query("daily_bars_from_ticks", "bars_ev", sql="SELECT * FROM bars_ev")
def daily_bars_from_ticks(m: Market):
    return m.bars_ev


@query("daily_bars_from_lines", "bars_li", sql="SELECT * FROM bars_li")
def daily_bars_from_lines(m: Market):
    return m.bars_li


@query("trading_calendar", "bars_li", sql="""
    SELECT day, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS idx
    FROM (SELECT DISTINCT day FROM bars_li) x""")
def trading_calendar(m: Market):
    return cal.numbered(cal.trading_calendar(m.bars_li))


_LAST_DAY = """
    WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) AS idx
                 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
                       WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5) x),
         asked AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
         hit AS (SELECT asked.date, max(cal.idx) AS idx FROM asked
                LEFT JOIN cal ON cal.day <= asked.date GROUP BY asked.date)
    SELECT hit.date, cal.day AS trading_day FROM hit LEFT JOIN cal ON cal.idx = hit.idx - {n}"""


def _ask(m: Market, n: int):
    weekdays = m.raw("orders").select(F.to_date("o_orderdate").alias("day")) \
        .filter(F.dayofweek("day").between(2, 6))
    asked = m.raw("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return cal.last_trading_day(asked, cal.trading_calendar(weekdays), "date", n)


@query("last_trading_day_0", sql=_LAST_DAY.format(n=0))
def last_trading_day_0(m: Market):
    return _ask(m, 0)


@query("last_trading_day_7", sql=_LAST_DAY.format(n=7))
def last_trading_day_7(m: Market):
    return _ask(m, 7)


@query("previous_trading_day_5", "bars_li", sql="""
    SELECT day, lag(day, 5) OVER (ORDER BY day) AS previous_day
    FROM (SELECT DISTINCT day FROM bars_li) x""")
def previous_trading_day_5(m: Market):
    return cal.previous_trading_days(cal.trading_calendar(m.bars_li), 5)


@query("screen_latest", "valuation", sql="""
    SELECT code, day, market_cap, capitalization, pe_ratio, pb_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM valuation) x
    WHERE n = 1 AND market_cap >= 20000 AND pe_ratio BETWEEN 50 AND 400""")
def screen_latest(m: Market):
    return scan.screen(m.valuation, {"market_cap": {"min": 20000},
                                     "pe_ratio": {"min": 50, "max": 400}})


@query("ranking_market_cap", "valuation", sql="""
    SELECT code, day, market_cap, capitalization, pe_ratio, pb_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM valuation) x
    WHERE n = 1 AND market_cap IS NOT NULL ORDER BY market_cap DESC, code LIMIT 10""")
def ranking_market_cap(m: Market):
    return scan.ranking(m.valuation, "market_cap", 10)
