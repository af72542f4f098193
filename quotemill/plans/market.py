"""Market and account tables derived from the driver's generic tables.

``Market(spark, dir)`` builds them with DataFrame operations; ``VIEWS`` gives the same
tables as SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import trades as tf
from quotemill.functions.codes import exchange_of, is_special_treatment, market_of
from quotemill.functions.values import money_sum, ratio, round_to
from quotemill.operators import ledger as ledger_ops
from quotemill.operators import series
from quotemill.operators.fundamentals import latest_version
from quotemill.session import shared_dir

EVENTS_AS_OF = "2024-01-30"
LEDGER_AS_OF = "2001-11-04"


def code_from(key: Column) -> Column:
    """At least six digits and a suffix by remainder: a code of its own for any integer key."""
    digits = key.cast("string")
    suffix = F.when(key % 3 == 0, ".SH").when(key % 3 == 1, ".SZ").otherwise(".BJ")
    return F.concat(F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")), suffix)


class Market:
    """The tables over one data folder. Every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self) -> dict[str, DataFrame]:
        """The tables written once to the shared folder, as a checking run finds them.

        Later tables are derived from the stored earlier ones.
        """
        base = shared_dir(self.spark, "market")
        kept = StoredMarket(self.spark, self.dir, base)
        for name in ("securities", "bars_li", "ledger", "positions", "accounts", "valuation",
                     "statements", "indicators"):
            getattr(Market, name).fget(kept).write.option("compression", "zstd").parquet(f"{base}/{name}")
            kept.done.add(name)
        return {"stock_list": kept.securities, "price_data": kept.bars_li,
                "valuation_data": kept.valuation, "indicator_data": kept.indicators,
                "user_transactions": kept.ledger, "user_positions": kept.positions,
                "user_account_info": kept.accounts}

    @property
    def securities(self) -> DataFrame:
        k, code = F.col("s_suppkey"), code_from(F.col("s_suppkey"))
        shown = F.when(k % 13 == 5, F.concat(F.lit("ST "), "s_name")).otherwise(F.col("s_name"))
        return self.raw("supplier").select(
            code.alias("code"), shown.alias("display_name"), F.col("s_name").alias("name"),
            F.to_date(F.lit("1995-01-01")).alias("start_date"),
            F.when(k % 10 == 7, F.to_date(F.lit("2000-06-30"))).alias("end_date"),
            exchange_of(code).alias("exchange"), market_of(code).alias("market"),
            F.when(k % 25 == 3, "index").otherwise("stock").alias("security_type"),
            F.when(k % 17 == 4, "suspended").otherwise("normal").alias("status"),
            is_special_treatment(shown).alias("is_st"),
            F.to_date(F.lit("2001-11-01")).alias("update_date"))

    @property
    def bars_ev(self) -> DataFrame:
        ticks = self.raw("events").select("user_id", "ts", "value")
        bars = series.daily_bars(ticks, "user_id", "ts", "value")
        return bars.withColumn("code", code_from(F.col("code"))).withColumn(
            "factor", 1.0 + (F.day("day") % 3) * 0.5)

    @property
    def bars_li(self) -> DataFrame:
        """Bars of line items; within a day prints follow order, line and price in cents."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        lines = self.raw("lineitem").select(
            "l_suppkey", "l_shipdate", "l_quantity",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + cents % 1048576)
            .alias("seq"))
        bars = series.daily_bars(lines, "l_suppkey", "l_shipdate", "price", size="l_quantity",
                                 order=F.col("seq"))
        return bars.drop("money").withColumn("code", code_from(F.col("code")))

    @property
    def ledger(self) -> DataFrame:
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax",
            "l_returnflag")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        base = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("trade_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            code_from(F.col("l_suppkey")).alias("stock_code"),
            F.to_date("o_orderdate").alias("trade_date"),
            F.when(F.col("l_returnflag") == "R", 24).otherwise(23).alias("trade_type"),
            F.concat(F.lit("str"), F.col("l_linenumber").cast("string"), F.lit("_"),
                     code_from(F.col("l_suppkey"))).alias("remark"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("amount"),
            (F.col("l_extendedprice") * 0.01).alias("commission"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("stamp_tax"),
            F.lit(0.0).alias("other_fees"))
        return base.withColumn("strategy_id", tf.strategy_from_prefix("remark")).withColumn(
            "net_amount", tf.net_amount("trade_type", "amount", "commission", "stamp_tax",
                                        "other_fees"))

    @property
    def positions(self) -> DataFrame:
        """Running holdings; every 13th of a month carries one share too many available."""
        joined = ledger_ops.running_positions(
            self.ledger, round_to(F.max("price"), 2).alias("current_price"),
            round_to(F.min("price"), 2).alias("open_price"))
        q, dom = F.col("position_quantity"), F.day("position_date")
        return joined.select(
            tf.position_id("user_id", "position_date", "stock_code").alias("position_id"),
            "user_id", "stock_code", "position_date", q.cast("int").alias("position_quantity"),
            (q.cast("int") + F.when(dom == 13, 1).otherwise(0)).alias("available_quantity"),
            F.lit(0).alias("frozen_quantity"), "open_price", "current_price",
            (q * F.col("current_price") * F.when(dom == 1, 1.25).otherwise(1.0))
            .alias("market_value")) \
            .withColumn("unrealized_pnl", tf.unrealized_pnl(
                F.col("position_quantity").cast("double"), F.col("open_price"),
                F.col("market_value"), F.col("current_price"))) \
            .withColumn("unrealized_pnl_ratio", tf.pnl_ratio(
                F.col("unrealized_pnl"), F.col("position_quantity").cast("double"),
                F.col("open_price")))

    @property
    def accounts(self) -> DataFrame:
        """Cash from the customer table; every 13th of a month the total is 11 off."""
        held = self.positions.groupBy("user_id", F.col("position_date").alias("info_date")).agg(
            money_sum("market_value").alias("position_market_value"))
        cash = self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("user_id"),
            F.col("c_acctbal").alias("available_cash"))
        extra = F.when(F.day("info_date") == 13, 11.0).otherwise(0.0)
        return held.join(cash, "user_id").select(
            "user_id", "info_date", "position_market_value", "available_cash",
            F.lit(0.0).alias("frozen_cash"),
            (F.col("position_market_value") + F.col("available_cash") + extra)
            .alias("total_assets"))

    @property
    def statements(self) -> DataFrame:
        """Quarterly sums per supplier, versioned by return flag; some balances are 2% off."""
        lines = self.raw("lineitem").select("l_suppkey", "l_shipdate", "l_returnflag",
                                            "l_extendedprice", "l_discount", "l_tax")
        quarter = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
        ext = F.col("l_extendedprice")
        sums = lines.groupBy(
            F.col("l_suppkey").alias("k"), quarter.alias("stat_date"),
            F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1)
            .otherwise(2).alias("report_type")).agg(
            money_sum(ext, 2).alias("total_operating_revenue"),
            money_sum(ext * F.col("l_discount")).alias("operating_cost"),
            money_sum(ext * F.col("l_tax")).alias("total_liability"))
        profit = F.col("total_operating_revenue") - F.col("operating_cost")
        off = F.when(F.col("k") % 10 == 3, 1.0625).otherwise(1.0)
        return sums.select(
            code_from(F.col("k")).alias("code"), F.date_add("stat_date", 30).alias("pub_date"),
            "stat_date", "report_type", "total_operating_revenue", "operating_cost",
            profit.alias("net_profit"),
            (F.col("total_operating_revenue") * off).alias("total_assets"), "total_liability",
            (F.col("total_operating_revenue") - F.col("total_liability"))
            .alias("total_sheet_owner_equities"))

    @property
    def indicators(self) -> DataFrame:
        """Ratios of the newest version of each quarter; eps is unknown for every fourth code."""
        s = latest_version(self.statements)
        unknown = F.right(F.substring_index("code", ".", 1), F.lit(1)).isin("3", "7")
        return s.select(
            "code", F.col("pub_date").alias("pubDate"), F.col("stat_date").alias("statDate"),
            F.when(~unknown, round_to(F.col("net_profit") / 10000.0, 4)).alias("eps"),
            round_to(ratio("net_profit", "total_assets"), 6).alias("roe"),
            round_to(ratio("total_liability", "total_assets"), 6).alias("roa"))

    @property
    def valuation(self) -> DataFrame:
        """Every seventh bar of a code has no valuation."""
        ranked = self.bars_li.withColumn("_n", F.row_number().over(series.by_day()))
        return ranked.filter(F.col("_n") % 7 != 0).select(
            "code", "day", (F.col("close") * F.col("volume")).alias("market_cap"),
            F.col("volume").alias("capitalization"), (F.col("close") / 8.0).alias("pe_ratio"),
            (F.col("high") / F.col("low")).alias("pb_ratio"))

    @property
    def margin(self) -> DataFrame:
        return self._feed("N", "fin_value", "sec_value")

    @property
    def money_flow(self) -> DataFrame:
        return self._feed("R", "inflow_xl", "outflow_xl")

    def _feed(self, flag: str, a: str, b: str) -> DataFrame:
        rows = self.raw("lineitem").filter(F.col("l_returnflag") == flag)
        return rows.groupBy(code_from(F.col("l_suppkey")).alias("code"),
                            F.to_date("l_shipdate").alias("day")).agg(
            money_sum("l_extendedprice", 2).alias(a), money_sum("l_quantity", 2).alias(b))

    @property
    def vendor_prices(self) -> DataFrame:
        """The event bars as a vendor would land them."""
        return self.bars_ev.select(
            F.col("code").alias("ts_code"), F.date_format("day", "yyyyMMdd").alias("trade_date"),
            "open", "high", "low", "close", F.col("volume").alias("vol"),
            F.when(F.day("day") == 7, -F.col("money")).otherwise(F.col("money")).alias("amount"))


class StoredMarket(Market):
    """Reads a table from storage once it is there."""

    def __init__(self, spark: SparkSession, sf_dir: str, base: str):
        super().__init__(spark, sf_dir)
        self.base, self.done = base, set()

    def __getattribute__(self, name: str):
        if name in ("base", "done", "spark", "dir") or name not in self.done:
            return super().__getattribute__(name)
        return self.spark.read.parquet(f"{self.base}/{name}")


def _code(x: str) -> str:
    return (f"(lpad(CAST({x} AS VARCHAR), CAST(greatest(6, length(CAST({x} AS VARCHAR))) AS INTEGER), '0') || "
            f"CASE {x} % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END)")


def _exchange(code: str) -> str:
    return (f"CASE right({code}, 3) WHEN '.SH' THEN 'XSHG' WHEN '.SZ' THEN 'XSHE' "
            f"WHEN '.BJ' THEN 'BSE' ELSE 'UNKNOWN' END")


def _market(code: str) -> str:
    return (f"CASE WHEN {code} LIKE '%.BJ' THEN 'bse' "
            f"WHEN {code} LIKE '%.SH' THEN CASE WHEN {code} LIKE '688%' THEN 'star' ELSE 'main' END "
            f"WHEN {code} LIKE '%.SZ' THEN CASE WHEN {code} LIKE '300%' THEN 'gem' ELSE 'main' END "
            f"ELSE 'unknown' END")


def dsum(x: str, scale: int = 4) -> str:
    return f"CAST(CAST(sum(CAST({x} AS DECIMAL(38,10))) AS DECIMAL(38,{scale})) AS DOUBLE)"


# name -> (tables it is built from, SQL text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "securities": ((), f"""
        SELECT code, CASE WHEN k % 13 = 5 THEN 'ST ' || s_name ELSE s_name END AS display_name,
               s_name AS name, DATE '1995-01-01' AS start_date,
               CASE WHEN k % 10 = 7 THEN DATE '2000-06-30' END AS end_date,
               {_exchange('code')} AS exchange, {_market('code')} AS market,
               CASE WHEN k % 25 = 3 THEN 'index' ELSE 'stock' END AS security_type,
               CASE WHEN k % 17 = 4 THEN 'suspended' ELSE 'normal' END AS status,
               (k % 13 = 5) OR s_name LIKE '%ST%' AS is_st, DATE '2001-11-01' AS update_date
        FROM (SELECT s_suppkey AS k, s_name, {_code('s_suppkey')} AS code FROM supplier) x"""),
    "bars_ev": ((), f"""
        SELECT {_code('user_id')} AS code, CAST(ts AS DATE) AS day, min_by(value, ts) AS open,
               max_by(value, ts) AS close, max(value) AS high, min(value) AS low,
               CAST(count(*) AS DOUBLE) AS volume, {dsum('value', 2)} AS money,
               1.0::DOUBLE + (day(CAST(ts AS DATE)) % 3) * 0.5::DOUBLE AS factor
        FROM events GROUP BY user_id, CAST(ts AS DATE)"""),
    "bars_li": ((), f"""
        SELECT {_code('l_suppkey')} AS code, day, min_by(price, seq) AS open,
               max_by(price, seq) AS close, max(price) AS high, min(price) AS low,
               {dsum('l_quantity', 2)} AS volume
        FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_quantity,
                     l_extendedprice / l_quantity AS price,
                     (l_orderkey * 8 + l_linenumber) * 1048576
                         + CAST(round(l_extendedprice * 100) AS BIGINT) % 1048576 AS seq
              FROM lineitem) x GROUP BY l_suppkey, day"""),
    "ledger": ((), f"""
        SELECT *, split_part(remark, '_', 1) AS strategy_id,
               CASE WHEN trade_type = 23 THEN amount + (commission + stamp_tax + other_fees)
                    ELSE amount - (commission + stamp_tax + other_fees) END AS net_amount
        FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS trade_id,
                     CAST(o_custkey AS VARCHAR) AS user_id, {_code('l_suppkey')} AS stock_code,
                     CAST(o_orderdate AS DATE) AS trade_date,
                     CASE WHEN l_returnflag = 'R' THEN 24 ELSE 23 END AS trade_type,
                     'str' || CAST(l_linenumber AS VARCHAR) || '_' || {_code('l_suppkey')} AS remark,
                     l_quantity AS quantity, l_extendedprice / l_quantity AS price,
                     l_extendedprice AS amount, l_extendedprice * 0.01::DOUBLE AS commission,
                     l_extendedprice * l_tax AS stamp_tax, 0.0::DOUBLE AS other_fees
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x"""),
    "positions": (("ledger",), f"""
        SELECT *, CASE WHEN unrealized_pnl IS NOT NULL AND open_price * position_quantity > 0
                       THEN unrealized_pnl / (open_price * position_quantity) END
                  AS unrealized_pnl_ratio
        FROM (SELECT *, CASE WHEN current_price > 0 AND open_price > 0
                             THEN market_value - open_price * position_quantity END AS unrealized_pnl
              FROM (SELECT 'POS_' || user_id || '_' || strftime(position_date, '%Y%m%d') || '_'
                           || stock_code AS position_id, user_id, stock_code, position_date,
                           CAST(q AS INTEGER) AS position_quantity,
                           CAST(q AS INTEGER) + CASE WHEN day(position_date) = 13 THEN 1 ELSE 0 END
                               AS available_quantity,
                           0 AS frozen_quantity, open_price, current_price,
                           CAST(q AS DOUBLE) * current_price
                               * CASE WHEN day(position_date) = 1 THEN 1.25::DOUBLE
                                      ELSE 1.0::DOUBLE END AS market_value
                    FROM (SELECT user_id, stock_code, position_date, open_price, current_price,
                                 sum(dq) OVER (PARTITION BY user_id, stock_code
                                               ORDER BY position_date) AS q
                          FROM (SELECT user_id, stock_code, trade_date AS position_date,
                                       round(min(price), 2) AS open_price,
                                       round(max(price), 2) AS current_price,
                                       sum(CAST(CASE WHEN trade_type = 23 THEN quantity
                                                     ELSE -quantity END AS DECIMAL(38,10))) AS dq
                                FROM ledger GROUP BY user_id, stock_code, trade_date) a) b) c) d"""),
    "accounts": (("positions",), f"""
        SELECT user_id, info_date, position_market_value, available_cash, 0.0::DOUBLE AS frozen_cash,
               position_market_value + available_cash
                   + CASE WHEN day(info_date) = 13 THEN 11.0::DOUBLE ELSE 0.0::DOUBLE END
                   AS total_assets
        FROM (SELECT user_id, position_date AS info_date, c_acctbal AS available_cash,
                     {dsum('market_value')} AS position_market_value
              FROM positions JOIN customer ON user_id = CAST(c_custkey AS VARCHAR)
              GROUP BY user_id, position_date, c_acctbal) x"""),
    "statements": ((), f"""
        SELECT {_code('k')} AS code, stat_date + 30 AS pub_date, stat_date, report_type,
               total_operating_revenue, operating_cost,
               total_operating_revenue - operating_cost AS net_profit,
               total_operating_revenue
                   * CASE WHEN k % 10 = 3 THEN 1.0625::DOUBLE ELSE 1.0::DOUBLE END AS total_assets,
               total_liability, total_operating_revenue - total_liability
                   AS total_sheet_owner_equities
        FROM (SELECT l_suppkey AS k,
                     last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE))
                         AS stat_date,
                     CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS report_type,
                     {dsum('l_extendedprice', 2)} AS total_operating_revenue,
                     {dsum('l_extendedprice * l_discount')} AS operating_cost,
                     {dsum('l_extendedprice * l_tax')} AS total_liability
              FROM lineitem GROUP BY 1, 2, 3) x"""),
    "indicators": (("statements",), """
        SELECT code, pub_date AS "pubDate", stat_date AS "statDate",
               CASE WHEN right(split_part(code, '.', 1), 1) NOT IN ('3', '7')
                    THEN round(net_profit / 10000.0::DOUBLE, 4) END AS eps,
               round(net_profit / nullif(total_assets, 0), 6) AS roe,
               round(total_liability / nullif(total_assets, 0), 6) AS roa
        FROM (SELECT *, row_number() OVER (PARTITION BY code, stat_date
                                           ORDER BY report_type DESC) AS rn FROM statements) x
        WHERE rn = 1"""),
    "valuation": (("bars_li",), """
        SELECT code, day, close * volume AS market_cap, volume AS capitalization,
               close / 8.0::DOUBLE AS pe_ratio, high / low AS pb_ratio
        FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day) AS rn FROM bars_li) x
        WHERE rn % 7 <> 0"""),
    "margin": ((), f"""
        SELECT {_code('l_suppkey')} AS code, CAST(l_shipdate AS DATE) AS day,
               {dsum('l_extendedprice', 2)} AS fin_value, {dsum('l_quantity', 2)} AS sec_value
        FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2"""),
    "money_flow": ((), f"""
        SELECT {_code('l_suppkey')} AS code, CAST(l_shipdate AS DATE) AS day,
               {dsum('l_extendedprice', 2)} AS inflow_xl, {dsum('l_quantity', 2)} AS outflow_xl
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"""),
    "vendor_prices": (("bars_ev",), """
        SELECT code AS ts_code, strftime(day, '%Y%m%d') AS trade_date, open, high, low, close,
               volume AS vol, CASE WHEN day(day) = 7 THEN -money ELSE money END AS amount
        FROM bars_ev"""),
}


def with_views(sql: str, *names: str) -> str:
    """Prefixes a query with the views it reads, and those they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    lead = sql.lstrip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{lead[5:]}"
    return f"WITH {ctes}\n{sql}"


def query_round(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds ratios and deviations to 6 places, where two engines agree."""
    return df.withColumns({c: round_to(c, 6) for c in columns})
