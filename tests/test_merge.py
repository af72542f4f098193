import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import merge
from quotemill.session import shared_dir

D = dt.date(2024, 1, 10)
KV = "k string, v int"


def kv(spark, *data):
    return spark.createDataFrame(list(data), KV)


def test_insert_or_ignore_is_idempotent(spark):
    old, new = kv(spark, ("a", 1)), kv(spark, ("a", 9), ("b", 3), ("b", 2), ("c", 4))
    once = merge.insert_or_ignore(old, new, ["k"])
    assert rows(once) == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(merge.insert_or_ignore(once, new, ["k"])) == rows(once)


def test_upsert_is_idempotent_and_last_wins(spark):
    old, new = kv(spark, ("a", 1), ("z", 0)), kv(spark, ("a", 8), ("a", 9), ("b", 3))
    once = merge.upsert(old, new, ["k"], ["v"])
    assert rows(once) == [("a", 9), ("b", 3), ("z", 0)]
    assert rows(merge.upsert(once, new, ["k"], ["v"])) == rows(once)


def test_upsert_last_is_told_by_the_order_not_by_the_values(spark):
    old = spark.createDataFrame([("a", 1, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 9, 1), ("a", 2, 2), ("a", 5, 0)], "k string, v int, seq int")
    assert rows(merge.upsert(old, new, ["k"], ["seq"])) == [("a", 2, 2)]
    with pytest.raises(TypeError):
        merge.upsert(old, new, ["k"])


def test_one_per_key_with_a_hot_key_does_not_depend_on_partitioning(spark, market):
    df = market.ledger.select(F.when(F.crc32("trade_id") % 3 == 0, "hot").otherwise(F.col("trade_id")).alias("k"),
                              "trade_date", "quantity", "user_id")
    a = merge.one_per_key(df, ["k"], ["trade_date"])
    assert rows(a) == rows(merge.one_per_key(df.repartition(7), ["k"], ["trade_date"]))
    p = df.toPandas().sort_values(["trade_date", "quantity", "user_id"]).groupby("k").first()
    assert {r.k: (r.trade_date, r.quantity, r.user_id) for r in a.collect()} == {
        k: tuple(v) for k, v in zip(p.index, p.itertuples(index=False))}


def test_delete_and_update_ignore_unknown_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], KV)
    assert rows(merge.delete_where(df, k="a", v=1)) == [("a", None), (None, 1)]
    assert rows(merge.update_where(df, {"v": 7}, k="a")) == [("a", 7), ("a", 7), (None, 1)]
    with pytest.raises(ValueError):
        merge.delete_where(df)


def test_import_trades_reports_duplicates(spark):
    schema = "trade_id string, trade_date date, q int"
    old = spark.createDataFrame([("in_table", D, 1), ("both", D, 1)], schema)
    batch = spark.createDataFrame([("in_batch", D, 1), ("in_batch", D, 2), ("both", D, 1), ("new", D, 1)], schema)
    accepted, duplicates, counts = merge.import_trades(old, batch)
    assert rows(accepted, "trade_id") == [("in_batch",), ("new",)]
    assert rows(duplicates, "trade_id") == [("both",)]
    assert rows(counts) == [(D, 2, 1)]


def test_import_snapshots(spark):
    schema = "user_id string, position_date date, c string"
    old = spark.createDataFrame([("u", D, "A"), ("u", D, "B")], schema)
    new = spark.createDataFrame([("u", D, "C"), ("v", D, "D")], schema)
    state, refused = merge.import_snapshots(old, new)
    assert rows(state, "c") == [("A",), ("B",), ("D",)] and rows(refused, "c") == [("C",)]
    state, refused = merge.import_snapshots(old, new, overwrite=True)
    assert rows(state, "c") == [("C",), ("D",)] and refused.count() == 0


def test_load_plan(spark):
    s = spark.createDataFrame([("A.SH", dt.date(2010, 1, 1), None), ("B.BJ", dt.date(2023, 6, 1), None),
                               ("C.SZ", dt.date(2010, 1, 1), None)], "code string, start_date date, end_date date")
    have = spark.createDataFrame([("A.SH", D), ("C.SZ", dt.date(2024, 1, 31))], "code string, day date")
    plan = merge.load_plan(s, {"price_data": (have, "day")}, "2024-01-31")
    got = {r.code: (str(r.start_day), str(r.end_day), r.skip, r.feed) for r in plan.collect()}
    assert got == {"A.SH": ("2024-01-11", "2024-01-31", False, "primary"),
                   "B.BJ": ("2023-06-01", "2024-01-31", False, "secondary"),
                   "C.SZ": ("2024-02-01", "2024-01-31", True, "primary")}
    full = merge.load_plan(s, {"daily_basic": (have, "day")}, "2024-01-31", full=True).filter("code = 'A.SH'").first()
    assert (str(full.start_day), full.feed) == ("2019-01-01", "secondary")


def test_remap_counts_collisions(spark):
    df = spark.createDataFrame([("430001.BJ", D), ("920001.BJ", D), ("600000.SH", D)], "code string, day date")
    m = spark.createDataFrame([(430001, "920001")], "old_code int, new_code string")
    assert rows(merge.remap_codes(df, m), "code") == [("600000.SH",), ("920001.BJ",), ("920001.BJ",)]
    assert rows(merge.remap_report(df, m)) == [("430001.BJ", "920001.BJ", 1, 1)]


def test_rekey_by_version(spark):
    df = spark.createDataFrame([("A", D, None, 1.0), ("A", D, 0, 1.0), ("A", D, 1, 2.0)],
                               "code string, stat_date date, report_type int, v double")
    assert rows(merge.with_version_key(df)) == [("A", D, 0, 1.0), ("A", D, 1, 2.0)]
    assert rows(merge.with_version_key(df.select("code", "stat_date").limit(1))) == [("A", D, 0)]


def test_freshness_tests(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 1),)], "update_date date")
    assert [merge.master_is_stale(s, d).first().stale for d in ("2024-01-08", "2024-01-09")] == [False, True]
    assert merge.master_is_stale(s.limit(0), "2024-01-01").first().stale
    f = spark.createDataFrame([(dt.date(2023, 9, 30),)], "stat_date date")
    due = [merge.financials_due([f], d).first().due for d in ("2023-12-20", "2023-12-30", "2024-04-01")]
    assert due == [False, True, True]


def test_factor_fill_only_where_the_feed_knows(spark):
    b = spark.createDataFrame([("A.BJ", D, None, None), ("B.BJ", D, 1.0, 1.0), ("C.SH", D, 1.0, 1.0)],
                              "code string, day date, factor double, adj_factor double")
    f = spark.createDataFrame([("A.BJ", D, 2.0), ("C.SH", D, 9.0)], "code string, day date, adj_factor double")
    assert rows(merge.fill_factors(b, f)) == [("A.BJ", D, 2.0, 2.0), ("B.BJ", D, 1.0, 1.0), ("C.SH", D, 1.0, 1.0)]


def test_partition_overwrite_touches_only_its_partitions(spark):
    path = shared_dir(spark, "parts") + "/t"
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 2, 2)], "k string, p int, v int")
    merge.write_partitions(df, path, ["p"])
    first = sorted(f for f in os.listdir(f"{path}/p=1") if f.endswith(".parquet"))
    stored = spark.read.parquet(path)
    new = spark.createDataFrame([("b", 2, 9), ("d", 2, 9)], "k string, p int, v int")
    state = merge.upsert(merge.touched_partitions(stored, new, ["p"]), new, ["k"], ["v"])
    merge.write_partitions(state, path, ["p"])      # reads the path it writes
    assert rows(spark.read.parquet(path), "k", "p", "v") == [
        ("a", 1, 1), ("b", 2, 9), ("c", 2, 2), ("d", 2, 9)]
    assert sorted(f for f in os.listdir(f"{path}/p=1") if f.endswith(".parquet")) == first


def test_map_rows_beyond_six_digits_are_rejected(spark):
    df = spark.createDataFrame([("430001.BJ",), ("000001.BJ",)], "code string")
    m = spark.createDataFrame([("4300017", "1"), ("1", "920001")], "old_code string, new_code string")
    assert rows(merge.remap_codes(df, m), "code") == [("430001.BJ",), ("920001.BJ",)]
    assert rows(merge.code_map_rejects(m), "old_code") == [("4300017",)]
