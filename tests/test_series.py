import datetime as dt
import math

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import calendar as cal
from quotemill.operators import series

D0 = dt.date(2024, 1, 1)   # a Monday


def bars(spark, closes, code="A", start=D0, step=1, factor=1.0):
    data = [(code, start + dt.timedelta(days=i * step), c, factor) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "code string, day date, close double, factor double")


def test_daily_returns_pad_and_zero(spark):
    b = bars(spark, [1.0, None, 2.0, 0.0, 3.0])
    padded = [r[-1] for r in sorted(rows(series.daily_returns(b)), key=lambda r: r[1])]
    assert padded == [None, 0.0, 1.0, -1.0, None]
    plain = [r[-1] for r in sorted(rows(series.daily_returns(b, pad=False)), key=lambda r: r[1])]
    assert plain == [None, None, None, -1.0, None]


def test_adjustment_modes(spark):
    b = bars(spark, [10.0], factor=1.5)
    assert series.adjusted(b).first().adj_close == 15.0
    assert series.adjusted(b, "none").first().adj_close == 10.0
    with pytest.raises(ValueError):
        series.adjusted(b, "back")


def test_volatility_needs_full_window_and_equals_pandas(spark):
    closes = [10 + math.sin(i) for i in range(25)]
    got = sorted(rows(series.volatility(bars(spark, closes), 20), "day", "volatility"))
    s = pd.Series(closes).pct_change(fill_method=None).rolling(20).std() * math.sqrt(252)
    assert [v is None for _, v in got] == [math.isnan(x) for x in s]
    assert got[20][1] is not None and got[19][1] is None
    for (_, v), x in zip(got, s):
        if v is not None:
            assert v == pytest.approx(x, rel=1e-9)


def test_moving_averages_only_with_enough_bars(spark):
    b = bars(spark, [float(i) for i in range(1, 21)]).unionByName(
        bars(spark, [float(i % 7) for i in range(250)], "B", D0 - dt.timedelta(days=230)))
    end = D0 + dt.timedelta(days=19)
    got = {r.code: r for r in series.moving_averages(b, end).collect()}
    assert (got["A"].ma5, got["A"].ma10, got["A"].ma20, got["A"].ma60) == (18.0, 15.5, 10.5, None)
    last = [float(i % 7) for i in range(250)]
    assert got["B"].ma250 == round(sum(last) / 250, 2) and got["B"].date == end


def test_moving_average_with_unknown_close_is_unknown(spark):
    got = series.moving_averages(bars(spark, [1.0, None, 3.0, 4.0, 5.0]), "2024-01-05", [2, 5]).first()
    assert (got.ma2, got.ma5) == (4.5, None)


def test_weekly_returns_keep_empty_weeks(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 7), dt.date(2024, 1, 8), dt.date(2024, 1, 24)]
    b = spark.createDataFrame([("A", d, float(c), 1.0) for d, c in zip(days, [1, 2, 3, 6])],
                              "code string, day date, close double, factor double")
    got = rows(series.weekly_returns(b), "day", "adj_close", "return")
    assert got == [(dt.date(2024, 1, 7), 2.0, None), (dt.date(2024, 1, 14), 3.0, 0.5),
                   (dt.date(2024, 1, 21), None, 0.0), (dt.date(2024, 1, 28), 6.0, 1.0)]


def test_monthly_returns_equal_pandas(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 4, 2), dt.date(2024, 5, 1)]
    b = spark.createDataFrame([("A", d, float(c), 1.0) for d, c in zip(days, [4, 5, 6, 9])],
                              "code string, day date, close double, factor double")
    got = rows(series.monthly_returns(b), "day", "adj_close", "return")
    m = pd.Series([4.0, 5, 6, 9], pd.to_datetime(days)).resample("ME").last()
    assert [(d, c) for d, c, _ in got] == [
        (i.date(), None if math.isnan(x) else x) for i, x in m.items()]
    want = m.ffill().pct_change()
    assert [r for *_, r in got] == [None if math.isnan(x) else pytest.approx(x) for x in want]


def test_price_range_of_flat_series_has_no_position(spark):
    b = bars(spark, [5.0] * 5).withColumn("high", F.col("close")).withColumn("low", F.col("close"))
    got = series.price_range(b, "2024-01-10").first()
    assert (got.highest, got.latest_close, got.avg_price, got.position_pct) == (5.0, 5.0, 5.0, None)


def test_latest_rows_with_ties(spark):
    df = spark.createDataFrame([("A", D0, 1), ("A", D0, 2), ("B", None, 3), ("B", D0, 4)],
                               "code string, day date, v int")
    assert rows(series.latest_rows(df, tie_break=["v"]), "code", "v") == [("A", 2), ("B", 4)]


def test_abnormal_moves_take_the_window_first(spark):
    b = bars(spark, [1.0, 2.0, 2.0, 4.1])
    assert len(rows(series.abnormal_moves(b, D0 + dt.timedelta(days=3), days=None))) == 2
    near = rows(series.abnormal_moves(b, D0 + dt.timedelta(days=3), days=2), "close", "prev_close")
    assert near == [(4.1, 2.0)]


def test_daily_bars_equal_brute_force_with_a_hot_code(spark, market):
    ticks = market.raw("events").select("user_id", "ts", "value")
    hot = ticks.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    got = {(r.code, r.day): (r.open, r.close, r.high, r.low, r.volume)
           for r in series.daily_bars(hot, "user_id", "ts", "value").collect()}
    p = hot.toPandas().sort_values("ts")
    p["day"] = p.ts.dt.date
    want = {k: (g.value.iloc[0], g.value.iloc[-1], g.value.max(), g.value.min(), float(len(g)))
            for k, g in p.groupby(["user_id", "day"])}
    assert got == want


def calendar(spark, *offsets):
    return spark.createDataFrame([(D0 + dt.timedelta(days=o),) for o in offsets], "day date")


def test_last_trading_day(spark):
    c = calendar(spark, 0, 1, 4, 5)
    asked = spark.createDataFrame([(D0 + dt.timedelta(days=o),) for o in (-1, 0, 2, 4, 9)], "date date")

    def look(n):
        return [None if t is None else (t - D0).days
                for _, t in sorted(rows(cal.last_trading_day(asked, c, n=n)))]

    assert look(0) == [None, 0, 1, 4, 5]
    assert look(1) == [None, None, 0, 1, 4]
    with pytest.raises(ValueError):
        cal.last_trading_day(asked, c, n=-1)


def test_trading_days_between(spark):
    c = calendar(spark, 0, 1, 4, 5)
    spans = [(-9, 99, 4), (1, 4, 2), (2, 3, 0), (4, 2, 0), (5, 5, 1), (6, 9, 0), (-5, -1, 0)]
    df = spark.createDataFrame([(D0 + dt.timedelta(days=a), D0 + dt.timedelta(days=b), n)
                                for a, b, n in spans], "a date, b date, n int")
    for r in cal.trading_days_between(df, c, "a", "b").collect():
        assert r.expected_days == r.n, r


def test_off_calendar_and_missing_days(spark):
    c = calendar(spark, 0, 1, 4, 5)
    snaps = spark.createDataFrame([("u", D0), ("u", D0 + dt.timedelta(days=2)),
                                   ("u", D0 + dt.timedelta(days=4))], "user string, d date")
    assert rows(cal.off_calendar(snaps, c, "d"), "d") == [(D0 + dt.timedelta(days=2),)]
    assert rows(cal.missing_snapshot_days(snaps, c, "d", D0)) == [(D0 + dt.timedelta(days=1),)]


def test_gap_fill_days(spark):
    b = spark.createDataFrame([("A", D0), ("A", D0 + dt.timedelta(days=5))], "code string, day date")
    assert rows(series.gap_fill_days(b, calendar(spark, 0, 1, 4, 5))) == [
        ("A", D0 + dt.timedelta(days=1)), ("A", D0 + dt.timedelta(days=4))]


def test_codes_of_any_length_stay_apart(spark):
    from quotemill.plans.market import code_from

    keys = [12345, 100000, 1000000, 1000003, 1234567890, 1234567893]
    codes = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(code_from(F.col("k"))).collect()]
    assert len(set(codes)) == len(keys)
    assert codes[0].startswith("012345.") and codes[4].startswith("1234567890.")


def test_money_is_price_times_size(spark):
    prints = spark.createDataFrame([(1, "2024-01-02 10:00:00", 3.125, 100.0), (1, "2024-01-02 11:00:00", 4.001, 200.0)],
                                   "c int, ts string, p double, n double").withColumn("ts", F.to_timestamp("ts"))
    assert series.daily_bars(prints, "c", "ts", "p", size="n").first()["money"] == 1112.7
