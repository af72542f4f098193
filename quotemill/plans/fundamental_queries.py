"""Versioned statements, point-in-time reads, feed merges and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions.values import round_to
from quotemill.operators import fundamentals as fun
from quotemill.plans.market import Market
from quotemill.plans.registry import query


@query("latest_statement_version", "statements", sql="""
    SELECT code, stat_date, report_type, total_operating_revenue
    FROM (SELECT *, row_number() OVER (PARTITION BY code, stat_date ORDER BY report_type DESC) AS n
          FROM statements) x WHERE n = 1""")
def latest_statement_version(m: Market):
    return fun.latest_version(m.statements).select(
        "code", "stat_date", "report_type", "total_operating_revenue")


@query("one_statement_version", "statements", sql="""
    SELECT code, stat_date, pub_date, net_profit FROM statements WHERE report_type = 1""")
def one_statement_version(m: Market):
    return fun.one_version(m.statements, 1).select("code", "stat_date", "pub_date", "net_profit")


@query("version_distribution", "statements", sql="""
    SELECT report_type, count(*) AS n_rows FROM statements GROUP BY report_type""")
def version_distribution(m: Market):
    return fun.version_distribution(m.statements)


@query("multi_version_keys", "statements", sql="""
    SELECT count(*) FILTER (n > 1) AS multi_version_keys, count(*) AS total_keys
    FROM (SELECT code, stat_date, count(*) AS n FROM statements GROUP BY 1, 2) x""")
def multi_version_keys(m: Market):
    return fun.multi_version_keys(m.statements)


@query("asof_or_latest_reports", "statements", sql="""
    SELECT code, pub_date, stat_date, report_type, in_range
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pub_date DESC, stat_date DESC,
                                       report_type DESC) AS n
          FROM (SELECT *, max(CASE WHEN in_range THEN 1 ELSE 0 END) OVER (PARTITION BY code) AS any_in
                FROM (SELECT *, pub_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS in_range
                      FROM statements WHERE code LIKE '%.SH' OR pub_date > DATE '1997-01-01') a) b
          WHERE in_range OR any_in = 0) c
    WHERE n <= 10""")
def asof_or_latest_reports(m: Market):
    """Codes outside Shanghai have no report in the range, so the fallback is used."""
    rows = m.statements.filter("code LIKE '%.SH' OR pub_date > DATE '1997-01-01'")
    out = fun.asof_or_latest(rows, "1996-01-01", "1996-12-31",
                             tie_break=["stat_date", "report_type"])
    return out.select("code", "pub_date", "stat_date", "report_type", "in_range")


@query("margin_flow_merge", "margin", "money_flow", sql="""
    SELECT coalesce(a.code, b.code) AS code, coalesce(a.day, b.day) AS day, fin_value, sec_value,
           inflow_xl, outflow_xl
    FROM margin a FULL OUTER JOIN money_flow b ON a.code = b.code AND a.day = b.day""")
def margin_flow_merge(m: Market):
    return fun.merge_margin_and_flow(m.margin, m.money_flow)


@query("one_sided_codes", "margin", "money_flow", sql="""
    SELECT code, 'margin_only' AS side FROM (SELECT code FROM margin WHERE code NOT LIKE '%5.SZ'
                                             EXCEPT SELECT code FROM money_flow WHERE code NOT LIKE '%0.BJ') x
    UNION ALL
    SELECT code, 'flow_only' FROM (SELECT code FROM money_flow WHERE code NOT LIKE '%0.BJ'
                                   EXCEPT SELECT code FROM margin WHERE code NOT LIKE '%5.SZ') y""")
def one_sided_codes(m: Market):
    return fun.one_sided_codes(m.margin.filter("code NOT LIKE '%5.SZ'"),
                               m.money_flow.filter("code NOT LIKE '%0.BJ'"))


@query("statement_balance_errors", "statements", sql="""
    SELECT code, stat_date, report_type, round(err, 6) AS error_ratio
    FROM (SELECT *, abs(total_assets - (total_liability + total_sheet_owner_equities))
                    / nullif(abs(total_assets), 0) AS err FROM statements) x WHERE err > 0.01""")
def statement_balance_errors(m: Market):
    return fun.balance_errors(m.statements).select(
        "code", "stat_date", "report_type", round_to("error_ratio", 6).alias("error_ratio"))


@query("market_cap_errors", "bars_li", "valuation", sql="""
    SELECT code, day, round(err, 6) AS error_ratio
    FROM (SELECT p.code, p.day, abs(v.market_cap - p.close * cap) / nullif(abs(v.market_cap), 0) AS err
          FROM bars_li p JOIN (SELECT *, CASE WHEN day(day) = 9 THEN capitalization * 1.125::DOUBLE
                                             ELSE capitalization END AS cap FROM valuation) v
            ON p.code = v.code AND p.day = v.day) x
    WHERE err > 0.05""")
def market_cap_errors(m: Market):
    """Shares of every ninth of a month are an eighth too high."""
    off = m.valuation.withColumn("capitalization", F.when(
        F.day("day") == 9, F.col("capitalization") * 1.125).otherwise(F.col("capitalization")))
    out = fun.market_cap_errors(m.bars_li, off, cap_unit=1.0, share_unit=1.0)
    return out.select("code", "day", round_to("error_ratio", 6).alias("error_ratio"))


@query("reconcile_statements", "statements", sql="""
    WITH a AS (SELECT code, stat_date, report_type, net_profit, pub_date FROM statements
               WHERE NOT (code LIKE '%3.SH' AND year(stat_date) = 1999)),
         b AS (SELECT code, stat_date, report_type,
                      CASE WHEN month(stat_date) = 6 THEN net_profit + 0.5::DOUBLE
                           WHEN month(stat_date) = 9 THEN net_profit + 0.0000000001::DOUBLE
                           ELSE net_profit END AS net_profit,
                      CASE WHEN code LIKE '%1.SZ' THEN pub_date + 1 ELSE pub_date END AS pub_date
               FROM statements WHERE NOT (code LIKE '%4.BJ' AND report_type = 2)),
         j AS (SELECT coalesce(a.code, b.code) AS code, coalesce(a.stat_date, b.stat_date) AS stat_date,
                      coalesce(a.report_type, b.report_type) AS report_type,
                      a.code IS NOT NULL AS in_a, b.code IS NOT NULL AS in_b,
                      a.net_profit AS na, b.net_profit AS nb, a.pub_date AS pa, b.pub_date AS pb
               FROM a FULL OUTER JOIN b ON a.code = b.code AND a.stat_date = b.stat_date
                 AND a.report_type = b.report_type)
    SELECT code, stat_date, report_type, issue, column_name FROM (
      SELECT *, 'left_only' AS issue, NULL AS column_name FROM j WHERE NOT in_b
      UNION ALL SELECT *, 'right_only', NULL FROM j WHERE NOT in_a
      UNION ALL SELECT *, 'value', 'net_profit' FROM j
        WHERE in_a AND in_b AND abs(na - nb) > 1e-9 + 1e-9 * abs(nb)
      UNION ALL SELECT *, 'value', 'pub_date' FROM j WHERE in_a AND in_b AND pa <> pb) x""")
def reconcile_statements(m: Market):
    cols = ["code", "stat_date", "report_type", "net_profit", "pub_date"]
    s = m.statements.select(*cols)
    left = s.filter(~(F.col("code").like("%3.SH") & (F.year("stat_date") == 1999)))
    month = F.month("stat_date")
    right = s.filter(~(F.col("code").like("%4.BJ") & (F.col("report_type") == 2))) \
        .withColumn("net_profit", F.when(month == 6, F.col("net_profit") + 0.5)
                    .when(month == 9, F.col("net_profit") + 1e-10).otherwise(F.col("net_profit"))) \
        .withColumn("pub_date", F.when(F.col("code").like("%1.SZ"), F.date_add("pub_date", 1))
                    .otherwise(F.col("pub_date")))
    return fun.reconcile(left, right, ["code", "stat_date", "report_type"]).select(
        "code", "stat_date", "report_type", "issue", "column_name")


@query("reconcile_ledger_totals", "ledger", sql="""
    SELECT issue, count(*) AS n FROM (
      SELECT CASE WHEN nb IS NULL THEN 'left_only' WHEN na <> nb THEN 'row_count' END AS issue
      FROM (SELECT a.trade_id, a.n AS na, b.n AS nb
            FROM (SELECT trade_id, count(*) AS n FROM ledger GROUP BY 1) a
            LEFT JOIN (SELECT trade_id, count(*) AS n FROM ledger WHERE trade_type = 23 GROUP BY 1) b
              ON a.trade_id = b.trade_id) x) y
    WHERE issue IS NOT NULL GROUP BY issue""")
def reconcile_ledger_totals(m: Market):
    """Repeated trade ids on both sides: compared by count and contents, not pair by pair."""
    cols = ["trade_id", "user_id", "stock_code", "quantity"]
    left = m.ledger.select(*cols)
    right = m.ledger.filter("trade_type = 23").select(*cols)
    return fun.reconcile(left, right, ["trade_id"]).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n"))


@query("reconcile_repeated_keys", "ledger", sql="""
    SELECT user_id, count(*) AS n FROM ledger GROUP BY user_id
    HAVING count(*) > 1 AND count(*) FILTER (user_id LIKE '%7') > 0""")
def reconcile_repeated_keys(m: Market):
    """Users with many rows on both sides; only the amounts of some of them differ beyond the tolerance."""
    left = m.ledger.select("user_id", "trade_id", "quantity", "amount")
    changed = F.when(F.col("user_id").endswith("7"), F.col("amount") + 1.0).otherwise(F.col("amount") * (1 + 1e-12))
    right = left.withColumn("amount", changed)
    return fun.reconcile(left, right, ["user_id"]).filter("issue = 'repeated'").select(
        "user_id", F.col("left_value").cast("bigint").alias("n"))


@query("reconcile_small_differences", "ledger", sql="""
    WITH keyed AS (SELECT user_id AS key, amount FROM ledger UNION ALL SELECT trade_id, amount FROM ledger),
         per AS (SELECT key, count(*) AS n, bool_or(key LIKE '%3' AND amount > 0) AS moved FROM keyed GROUP BY key)
    SELECT key, CASE WHEN n = 1 THEN 'value' ELSE 'repeated' END AS issue FROM per WHERE moved""")
def reconcile_small_differences(m: Market):
    """Fifty tolerances are reported on single and on repeated keys alike, a tenth of one on neither."""
    keyed = m.ledger.select(F.col("user_id").alias("key"), "amount").unionByName(
        m.ledger.select(F.col("trade_id").alias("key"), "amount"))
    off = F.when(F.col("key").endswith("3"), 1 + 5e-8).otherwise(F.lit(1 + 1e-10))
    return fun.reconcile(keyed, keyed.withColumn("amount", F.col("amount") * off), ["key"]).select("key", "issue")


@query("bars_with_known_statement", "bars_li", "statements", sql="""
    SELECT code, day, close, stat_date, report_type, total_assets FROM (
      SELECT p.code, p.day, p.close, s.stat_date, s.report_type, s.total_assets,
             row_number() OVER (PARTITION BY p.code, p.day ORDER BY s.stat_date DESC NULLS LAST,
                                s.report_type DESC) AS rn
      FROM bars_li p LEFT JOIN statements s ON s.code = p.code AND s.pub_date <= p.day) x WHERE rn = 1""")
def bars_with_known_statement(m: Market):
    """Every bar with the newest quarter's highest version that was published by its day."""
    out = fun.with_known_statement(m.bars_li.select("code", "day", "close"), m.statements)
    return out.select("code", "day", "close", *[
        F.col(f"statement.{c}").alias(c) for c in ("stat_date", "report_type", "total_assets")])
