import datetime as dt

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotemill.operators import coverage as cov
from quotemill.operators import ledger

TRADE = ("trade_id string, user_id string, stock_code string, trade_date date, trade_type int, "
         "quantity double, price double, amount double, commission double, stamp_tax double, "
         "other_fees double, net_amount double")
D = dt.date(2024, 1, 10)


def trades(spark, data):
    out = []
    for i, (user, code, day, kind, qty, price) in enumerate(data):
        amount = qty * price
        out.append((f"t{i}", user, code, day, kind, qty, price, amount, 1.0, 0.5, 0.0,
                    amount + (1.5 if kind == 23 else -1.5)))
    return spark.createDataFrame(out, TRADE)


def test_net_positions_keep_only_what_is_left(spark):
    t = trades(spark, [("u", "A.SH", D, 23, 10.0, 2.0), ("u", "A.SH", D, 24, 4.0, 3.0),
                       ("u", "B.SH", D, 23, 5.0, 1.0), ("u", "B.SH", D, 24, 5.0, 1.0),
                       ("u", "C.SH", D, 24, 5.0, 1.0), ("u", "D.SH", D, 23, 9.0, 1.0),
                       ("u", "D.SH", D, 99, 2.0, 1.0)])
    got = rows(ledger.net_positions(t), "stock_code", "total_quantity", "total_amount",
               "transaction_count")
    assert got == [("A.SH", 6.0, 21.5 - 10.5, 2), ("D.SH", 7.0, 10.5 - 0.5, 2)]
    assert rows(ledger.net_positions(t, end=D - dt.timedelta(days=1))) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["u", "v"]), st.sampled_from(["A.SH", "B.SZ"]),
                          st.sampled_from([23, 24]), st.integers(1, 50)), min_size=1, max_size=30))
def test_net_equals_bought_minus_sold(spark, data):
    t = trades(spark, [(u, c, D, k, float(q), 1.0) for u, c, k, q in data])
    net = {(r.user_id, r.stock_code): r.total_quantity for r in ledger.net_positions(t).collect()}
    both = {(r.user_id, r.stock_code): r.buy_quantity - r.sell_quantity
            for r in ledger.user_summary(t).collect()}
    assert net == {k: v for k, v in both.items() if v > 0}


def test_user_summary_and_totals(spark):
    later = D + dt.timedelta(days=3)
    t = trades(spark, [("u", "A.SH", D, 23, 10.0, 2.0), ("u", "A.SH", later, 24, 4.0, 3.0)])
    r = ledger.user_summary(t).first()
    assert (r.trade_count, r.buy_amount, r.sell_amount, r.total_fees, r.first_trade_date,
            r.last_trade_date) == (2, 20.0, 12.0, 3.0, D, later)
    assert tuple(ledger.ledger_totals(t).first()) == (2, 1, 1, D, later, 1, 1)
    day = ledger.daily_summary(t, D).first()
    assert (day.trade_count, day.total_amount, day.trade_type_name) == (1, 20.0, "买入")


def test_running_positions_equal_brute_force_with_a_hot_user(spark, market):
    t = market.ledger.withColumn("user_id", F.when(
        F.crc32("user_id") % 3 == 0, "hot").otherwise(F.col("user_id")))
    got = {(r.user_id, r.stock_code, r.position_date): r.position_quantity
           for r in ledger.running_positions(t).collect()}
    p = t.select("user_id", "stock_code", "trade_date", "trade_type", "quantity").toPandas()
    p["q"] = p.quantity.where(p.trade_type == 23, -p.quantity)
    s = p.groupby(["user_id", "stock_code", "trade_date"]).q.sum().groupby(level=[0, 1]).cumsum()
    assert got == s.to_dict()


POS = ("position_id string, user_id string, stock_code string, position_date date, "
       "position_quantity int, available_quantity int, frozen_quantity int, open_price double, "
       "market_value double, current_price double")


def test_position_validity(spark):
    good = ("p", "u", "A.SH", D, 10, 6, 4, 1.0, 10.0, 1.0)
    bad = [("p", "u", "A.SH", D, 10, 7, 4, 1.0, 10.0, 1.0), ("p", "u", "A.SH", D, 10, 0, 11, 1.0, 10.0, None),
           ("", "u", "A.SH", D, 10, 6, 4, 1.0, 10.0, 1.0), ("p", "u", "A", D, 10, 6, 4, 1.0, 10.0, 1.0),
           ("p", "u", "A.SH", D, 10, 6, 4, 1.0, -1.0, 1.0), ("p", "u", "A.SH", D, -1, 0, 0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame([good, (*good[:-1], None), *bad], POS)
    ok, rejects = ledger.split_valid(df, "user_positions")
    assert ok.count() == 2 and rejects.count() == len(bad)


def test_trade_validity(spark):
    t = trades(spark, [("u", "A.SH", D, 23, 10.0, 2.0), ("u", "A", D, 23, 10.0, 2.0),
                       ("u", "A.SH", D, 99, 10.0, 2.0), ("u", "A.SH", D, 23, 0.0, 2.0)])
    timed = t.withColumn("trade_time", F.lit(dt.datetime(2024, 1, 10, 9, 30)).cast("timestamp_ntz"))
    assert [r.is_valid for r in ledger.with_validity(timed, "user_transactions")
            .orderBy("trade_id").collect()] == [True, False, False, False]
    late = timed.withColumn("trade_time", F.lit(dt.datetime(2024, 1, 11)).cast("timestamp_ntz"))
    assert not any(r.is_valid for r in ledger.with_validity(late, "user_transactions").collect())


def test_account_imbalance_warns_above_ten(spark):
    df = spark.createDataFrame([("u", D, 110.0, 50.0, 50.0, 0.0), ("u", D, 110.01, 50.0, 50.0, 0.0),
                                ("u", D, 90.0, 50.0, -1.0, 0.0)],
                               "user_id string, info_date date, total_assets double, "
                               "position_market_value double, available_cash double, frozen_cash double")
    got = [(r.is_valid, r.imbalance_warning) for r in ledger.with_validity(df, "user_account_info").collect()]
    assert got == [(True, False), (True, True), (False, True)]


def test_security_and_statement_validity(spark):
    s = spark.createDataFrame([("1.XSHG", "n", D, None), ("1.SH", "n", D, D - dt.timedelta(days=1)),
                               ("1.NY", "n", D, None), ("1.SH", "", D, None)],
                              "code string, display_name string, start_date date, end_date date")
    assert [r.is_valid for r in ledger.with_validity(s, "stock_list").collect()] == [True, False, False, False]
    f = spark.createDataFrame([("1", D), ("", D), ("1", None)], "code string, stat_date date")
    assert [r.is_valid for r in ledger.with_validity(f, "balance_sheet").collect()] == [True, False, False]


def test_marks_and_revaluation(spark):
    df = spark.createDataFrame([("a", "u", "A.SH", D, 10, 10, 0, 2.0, 30.0, None),
                                ("b", "u", "B.SH", D, 0, 0, 0, 2.0, 0.0, None),
                                ("c", "u", "C.SH", D, 5, 5, 0, 0.0, 10.0, None)], POS)
    marked = {r.position_id: r for r in ledger.with_marks(df).collect()}
    assert (marked["a"].current_price, marked["a"].unrealized_pnl, marked["a"].unrealized_pnl_ratio) == (3.0, 10.0, 0.5)
    assert (marked["b"].current_price, marked["b"].unrealized_pnl) == (None, None)
    assert (marked["c"].current_price, marked["c"].unrealized_pnl) == (2.0, None)
    px = spark.createDataFrame([("A.SH", 4.0), ("B.SH", 9.0)], "code string, price double")
    out = {r.position_id: r for r in ledger.revalue(df, px).collect()}
    assert (out["a"].current_market_value, out["a"].unrealized_pnl, out["a"].unrealized_pnl_ratio) == (40.0, 20.0, 1.0)
    assert (out["b"].unrealized_pnl, out["c"].unrealized_pnl, out["c"].current_market_value) == (0.0, 0.0, 0.0)


def test_snapshot_gap_of_eight_days_not_seven(spark):
    days = [0, 7, 7, 15, 16]
    df = spark.createDataFrame([("u", D + dt.timedelta(days=d)) for d in days], "user_id string, position_date date")
    assert rows(ledger.snapshot_gaps(df), "gap_days") == [(8,)]
    assert rows(ledger.snapshot_gap_counts(df)) == [("u", 1)]


def test_position_summary_uses_newest_date_per_user(spark, market):
    p = market.positions
    got = {r.user_id: (r.position_date, r.total_positions) for r in ledger.position_summary(p).collect()}
    newest = {r.user_id: r.d for r in p.groupBy("user_id").agg(F.max("position_date").alias("d")).collect()}
    for user, (day, n) in got.items():
        assert day == newest[user] and n >= 1
    top = ledger.top_positions(p, 2)
    assert max(r["count"] for r in top.groupBy("user_id").count().collect()) <= 2


def test_unknown_codes_and_their_rows(spark):
    facts = spark.createDataFrame([("A", 1), ("A", 2), ("X", 3), (None, 4)], "stock_code string, v int")
    master = spark.createDataFrame([("A",)], "code string")
    assert rows(cov.unknown_codes(facts, master)) == [("X", 1)]
    assert rows(cov.rows_with_unknown_code(facts, master), "v") == [(3,), (4,)]


def test_running_positions_shuffle_the_trades_once(spark):
    trades = [("u", "A.SH", dt.date(2024, 1, d), 23 if d % 3 else 24, 10.0 * d) for d in (1, 2, 2, 3, 5)] + [(None, None, dt.date(2024, 1, 1), 23, 1.0)]
    t = spark.createDataFrame(trades, "user_id string, stock_code string, trade_date date, trade_type int, quantity double")
    held = ledger.running_positions(t)
    assert rows(held, "user_id", "position_date", "position_quantity") == [
        ("u", dt.date(2024, 1, 1), 10.0), ("u", dt.date(2024, 1, 2), 50.0), ("u", dt.date(2024, 1, 3), 20.0),
        ("u", dt.date(2024, 1, 5), 70.0), (None, dt.date(2024, 1, 1), 1.0)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ENSURE_REQUIREMENTS" not in plan
