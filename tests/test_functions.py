import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.functions import codes, dates, trades, values


@pytest.fixture(scope="module")
def dialects(spark):
    texts = ["000001.XSHE", "600000.XSHG", "430047.BSE", "430047.BJSE", "8300", "688001", "300001",
             "900001", "200011", "123456", "abc", "600000.SH", None]
    return spark.createDataFrame([(t,) for t in texts], "c string")


def test_standard_code(dialects):
    got = dict(rows(dialects.filter("c IS NOT NULL").select("c", codes.standard_code("c").alias("s"))))
    assert got == {
        "000001.XSHE": "000001.SZ", "600000.XSHG": "600000.SH", "430047.BSE": "430047.BJ",
        "430047.BJSE": "430047.BJ", "8300": "8300.BJ", "688001": "688001.SH",
        "300001": "300001.SZ", "900001": "900001.SH", "200011": "200011.SZ", "123456": "123456",
        "abc": "abc", "600000.SH": "600000.SH"}


def test_vendor_code_exchange_and_board(spark):
    df = spark.createDataFrame([("000001.SZ",), ("600000.SH",), ("688001.SH",), ("300001.SZ",),
                                ("830001.BJ",), ("zzz",)], "c string")
    got = {r[0]: tuple(r[1:]) for r in df.select(
        "c", codes.vendor_code("c"), codes.exchange_of("c"), codes.market_of("c")).collect()}
    assert got == {
        "000001.SZ": ("000001.XSHE", "XSHE", "main"), "600000.SH": ("600000.XSHG", "XSHG", "main"),
        "688001.SH": ("688001.XSHG", "XSHG", "star"), "300001.SZ": ("300001.XSHE", "XSHE", "gem"),
        "830001.BJ": ("830001.BSE", "BSE", "bse"), "zzz": ("zzz", "UNKNOWN", "unknown")}


def test_names_and_flags(spark):
    df = spark.createDataFrame([("XSHG", "star", 23), ("SSE", "odd", 24), (None, None, 7)],
                               "e string, m string, t int")
    got = df.select(codes.exchange_name("e"), codes.market_name("m"), codes.trade_type_name("t"),
                    codes.canonical_exchange("e")).collect()
    assert [tuple(r) for r in got] == [
        ("上海证券交易所", "科创板", "买入", "XSHG"), ("SSE", "odd", "卖出", "XSHG"),
        ("未知", "未知", "未知", None)]
    names = spark.createDataFrame([("*ST Foo",), ("Foo",), (None,)], "n string")
    assert [r[0] for r in names.select(codes.is_special_treatment("n")).collect()] == [True, False, False]


def test_exchange_scope_rejects_unknown():
    with pytest.raises(ValueError):
        codes.in_exchange_scope("c", "nyse")


def test_parse_date_forms(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024/01/05",), ("20240105",), ("",), ("soon",),
                                ("20241399",)], "d string")
    d = dt.date(2024, 1, 5)
    assert [r[0] for r in df.select(dates.parse_date("d")).collect()] == [d, d, d, None, None, None]


def test_due_quarter_every_month(spark):
    df = spark.range(1, 13).select(F.make_date(F.lit(2024), "id", F.lit(15)).alias("d"))
    got = [r[0].isoformat() for r in df.select("d", dates.due_report_quarter("d").alias("q"))
           .orderBy("d").select("q").collect()]
    assert got == ["2023-12-31"] * 3 + ["2024-03-31"] + ["2024-06-30"] * 4 + ["2024-09-30"] * 2 + \
        ["2024-12-31"] * 2


def test_trade_timestamp_falls_back_to_midnight(spark):
    df = spark.createDataFrame([("09:31:05",), ("9:1:5",), ("99:00:00",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(dates.trade_timestamp(dates.day("2024-01-05"), F.col("t"))).collect()]
    mid = dt.datetime(2024, 1, 5)
    assert got == [dt.datetime(2024, 1, 5, 9, 31, 5), dt.datetime(2024, 1, 5, 9, 1, 5), mid, mid, mid]


def test_week_end_far_future_and_cutoff(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7), dt.datetime(2024, 1, 7, 14, 59)),
                                (dt.date(2200, 1, 1), dt.datetime(2024, 1, 7, 15, 0))],
                               "d date, t timestamp_ntz")
    got = [tuple(r) for r in df.select(dates.week_end("d"), dates.drop_far_future("d"),
                                       dates.last_closed_day("t")).collect()]
    assert got == [(dt.date(2024, 1, 7), dt.date(2024, 1, 7), dt.date(2024, 1, 6)),
                   (dt.date(2200, 1, 5), None, dt.date(2024, 1, 7))]


def test_load_window_bounds(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1), None), (dt.date(2020, 5, 1), dt.date(2021, 1, 1)),
                                (None, dt.date(2200, 1, 1))], "s date, e date")
    got = [tuple(map(str, r)) for r in df.select(
        dates.window_start("s"), dates.window_end(None, "e", "2024-01-01")).collect()]
    assert got == [("2019-01-01", "2024-01-01"), ("2020-05-01", "2021-01-01"),
                   ("2019-01-01", "2024-01-01")]


def test_strategy_tags(spark):
    df = spark.createDataFrame([("str1001_600335.SH",), ("_x",), ("plain",), ("a strategy_id: s7 ",),
                                (None,)], "r string")
    got = [tuple(r) for r in df.select(trades.strategy_from_prefix("r"),
                                       trades.strategy_from_tag("r")).collect()]
    assert got == [("str1001", None), (None, None), (None, None), ("a strategy", "s7"), (None, None)]


def test_generated_id_is_stable_and_tells_repeats_apart(spark):
    df = spark.createDataFrame([("u", "c", 1.0, 0), ("u", "c", 1.0, 1), ("u", None, 1.0, 0)],
                               "u string, c string, p double, pos int")
    ids = df.select(trades.generated_trade_id("u", "c", "p", "pos").alias("i"))
    a, b = [r.i for r in ids.collect()], [r.i for r in ids.repartition(3).collect()]
    assert len(set(a)) == 3 and sorted(a) == sorted(b)


def test_net_amount(spark):
    df = spark.createDataFrame([(23, 100.0, 1.0, 2.0), (24, 100.0, 1.0, 2.0), (99, 100.0, 1.0, 2.0)],
                               "t int, a double, c double, s double")
    assert [r[0] for r in df.select(trades.net_amount("t", "a", "c", "s")).collect()] == [103, 97, 97]


def test_round_to_works_on_the_binary_value(spark):
    df = spark.createDataFrame([(35.925,), (1.005,), (2.5,), (None,)], "x double")
    got = [tuple(r) for r in df.select(values.round_to("x", 2)).collect()]
    assert got[0] == (35.92,) and got[2:] == [(2.5,), (None,)]


def test_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (1e9,), (-1e9,)], "x double")
    got = {df.repartition(n).agg(values.money_sum("x")).first()[0] for n in (1, 2, 5)}
    assert got == {0.6}


def test_sums_round_the_total_not_the_addends(spark):
    df = spark.createDataFrame([(0.00004, 2e14), (0.00004, 3e17), (0.00004, None)], "x double, big double")
    assert tuple(df.agg(values.money_sum("x"), values.money_sum("big", 8)).first()) == (0.0001, 3.002e17)


def test_codes_by_list_or_by_join_are_the_same_rows(spark, monkeypatch):
    from quotemill.operators import scan

    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "code string, n int")
    by_list = rows(scan.for_codes(df, ["b", "b", "z"]))
    monkeypatch.setattr(scan, "CODE_LIST_LIMIT", 2)
    assert rows(scan.for_codes(df, ["b", "b", "z"])) == by_list == [("b", 2), ("b", 3)]


def test_blank_to_null(spark):
    from quotemill.sources.landed import clean_blanks

    df = spark.createDataFrame([("", float("nan"), 1), ("a", 2.0, None)], "s string, d double, i int")
    assert rows(clean_blanks(df)) == [("a", 2.0, None), (None, None, 1)]
