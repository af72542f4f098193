import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import fundamentals as fun

Q = dt.date(2023, 12, 31)


def test_latest_version_with_unknown_version(spark):
    df = spark.createDataFrame([("A", Q, 0, 1.0), ("A", Q, 2, 3.0), ("A", Q, 1, 2.0), ("A", Q, None, 9.0),
                                ("B", Q, None, 4.0)], "code string, stat_date date, report_type int, v double")
    assert rows(fun.latest_version(df), "code", "v") == [("A", 3.0), ("B", 4.0)]
    assert tuple(fun.multi_version_keys(df).first()) == (1, 2)


def test_asof_falls_back_per_code(spark):
    def d(i):
        return dt.date(2024, 1, 1) + dt.timedelta(days=i)

    data = [("A", d(i), d(i)) for i in range(12)] + [("B", d(100), d(100)), ("B", d(101), d(101))]
    df = spark.createDataFrame(data, "code string, pub_date date, stat_date date")
    got = rows(fun.asof_or_latest(df, d(5), d(7)), "code", "pub_date", "in_range")
    assert got == [("A", d(i), True) for i in (5, 6, 7)] + [("B", d(i), False) for i in (100, 101)]
    assert fun.asof_or_latest(df, d(200), d(300)).filter("code = 'A'").count() == 10


def test_outer_merge_of_margin_and_flow(spark):
    a = spark.createDataFrame([("A", Q, 1.0), ("B", Q, 2.0)], "code string, day date, fin_value double")
    b = spark.createDataFrame([("B", Q, 5.0, 0.0), ("C", Q, 6.0, 0.0)],
                              "code string, day date, inflow_xl double, unrelated double")
    assert rows(fun.merge_margin_and_flow(a, b)) == [
        ("A", Q, 1.0, None), ("B", Q, 2.0, 5.0), ("C", Q, None, 6.0)]
    assert rows(fun.one_sided_codes(a, b)) == [("A", "margin_only"), ("C", "flow_only")]


def test_reconcile_tolerance_nulls_and_extra_rows(spark):
    schema = "id int, k string, x double, s string, d timestamp_ntz"
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 8)
    left = spark.createDataFrame([(1, "tiny", 1.0, "a", t1), (2, "big", 1.0, "a", t1),
                                  (3, "nulls", None, None, None), (4, "half", None, "a", t1),
                                  (5, "left", 1.0, "a", t1)], schema)
    right = spark.createDataFrame([(9, "tiny", 1.0 + 1e-12, "a", t2), (8, "big", 1.001, "b", t1),
                                   (7, "nulls", None, None, None), (6, "half", 2.0, "a", t1),
                                   (5, "right", 1.0, "a", t1)], schema)
    got = rows(fun.reconcile(left, right, ["k"]), "k", "issue", "column_name")
    assert got == [("big", "value", "s"), ("big", "value", "x"), ("half", "value", "x"),
                   ("left", "left_only", None), ("right", "right_only", None)]


def test_reconcile_repeated_and_null_keys(spark):
    schema = "k string, x double"
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), (None, 1.0)], schema)
    right = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", 1.0), ("c", 1.0),
                                   (None, 1.0)], schema)
    assert rows(fun.reconcile(left, right, ["k"]), "k", "issue", "left_value", "right_value") == [
        ("b", "repeated", "2", "2"), ("c", "row_count", "1", "2")]


def test_reconcile_equals_brute_force_with_a_hot_key(spark, market):
    t = market.ledger.select(F.when(F.crc32("trade_id") % 3 == 0, "hot").otherwise(F.col("trade_id")).alias("k"),
                             "quantity")
    changed = t.withColumn("quantity", F.when(F.col("k").endswith("-3"), F.col("quantity") + 1)
                           .otherwise(F.col("quantity")))
    got = {r.k for r in fun.reconcile(t, changed, ["k"]).collect()}
    from collections import defaultdict

    sides = []
    for df in (t, changed):
        groups = defaultdict(list)
        for r in df.collect():
            groups[r.k].append(r.quantity)
        sides.append({k: sorted(v) for k, v in groups.items()})
    assert got == {k for k in sides[0] if sides[0][k] != sides[1][k]}


def test_missing_columns_and_checks(spark):
    a = spark.createDataFrame([(1, 2)], "k int, a int")
    b = spark.createDataFrame([(1, 2)], "k int, b int")
    assert rows(fun.missing_columns(a, b)) == [("a", "missing_in_right"), ("b", "missing_in_left")]
    s = spark.createDataFrame([(100.0, 60.0, 39.5), (100.0, 60.0, 38.0), (0.0, 0.0, 0.0)],
                              "total_assets double, total_liability double, total_sheet_owner_equities double")
    assert rows(fun.balance_errors(s), "total_sheet_owner_equities") == [(38.0,)]
    p = spark.createDataFrame([("A", Q, 10.0), ("B", Q, 10.0)], "code string, day date, close double")
    v = spark.createDataFrame([("A", Q, 1.0, 1000.0), ("B", Q, 2.0, 1000.0)],
                              "code string, day date, market_cap double, capitalization double")
    assert rows(fun.market_cap_errors(p, v), "code") == [("B",)]


def test_reconcile_repeated_keys_within_the_tolerance(spark):
    ints = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "k string, v int")
    near = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 1.0), ("b", 2.0000000001)], "k string, v double")
    assert rows(fun.reconcile(ints, near, ["k"])) == []
    assert rows(fun.reconcile(near, ints, ["k"])) == []
    far = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 1.0), ("b", None)], "k string, v double")
    assert rows(fun.reconcile(ints, far, ["k"]), "k", "issue") == [("b", "repeated")]


def test_reconcile_folds_both_sides_in_one_shuffle(spark):
    t = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = fun.reconcile(t, t.withColumnRenamed("v", "w"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_small_differences_of_repeated_keys_are_reported_like_those_of_single_ones(spark):
    left = [("one", 2.0), ("two", 2.0), ("two", 5.0), ("near", 2.0), ("near", 5.0)]
    for by, reported in ((5e-8, True), (1e-8, True), (5e-10, False)):
        right = [("one", 2.0 + by), ("two", 5.0), ("two", 2.0 + by), ("near", 5.0 + 1e-10), ("near", 2.0)]
        got = rows(fun.reconcile(*[spark.createDataFrame(x, "k string, v double") for x in (left, right)], ["k"]), "k", "issue")
        assert got == ([("one", "value"), ("two", "repeated")] if reported else []), by


def test_matching_hands_partners_on():
    """The first row could take either partner, the second only the one the first took."""
    assert fun.matched([(1.0,), (1.6,)], [(1.5,), (0.5,)], [True], 0.7, 0.0) == 2
    assert fun.matched([(1.0, "a"), (1.0, "b")], [(1.0, "b"), (1.0, "c")], [True, False], 0.1, 0.0) == 1
    nan, inf = float("nan"), float("inf")
    assert fun.matched([(None,), (nan,), (inf,), (1.0,)], [(1.0,), (nan,), (None,), (inf,)], [True], 0.1, 0.1) == 4


def test_matching_equals_brute_force():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([(rng.choice([0.0, 0.4, 0.9, 1.3, None]), rng.choice(["x", "y"])) for _ in range(4)] for _ in range(2))
        near = lambda x, y: x[1] == y[1] and (x[0] is y[0] or None not in (x[0], y[0]) and abs(x[0] - y[0]) <= 0.5)
        want = max(sum(near(x, y) for x, y in zip(a, p)) for p in itertools.permutations(b))
        assert fun.matched(a, b, [True, False], 0.5, 0.0) == want


def test_repeated_keys_with_a_hot_key_in_runs(spark):
    """One key holds most rows; a single one of them differs."""
    base = spark.range(3000).selectExpr("if(id < 2500, 'hot', concat('k', id % 50)) AS k", "cast(id AS double) AS v", "'t' AS t")
    near = base.withColumn("v", F.col("v") + 1e-10 * (F.col("v") + 1))
    assert rows(fun.reconcile(base, near, ["k"])) == []
    off = near.withColumn("v", F.when(F.col("v").between(1200, 1200.5), F.col("v") + 1e-5).otherwise(F.col("v")))
    assert rows(fun.reconcile(base, off, ["k"]), "k", "issue") == [("hot", "repeated")]


def test_reconcile_shuffles_its_rows_once_by_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fun, "stored", lambda df, purpose: seen.append(df) or df)
    left = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), (None, "x", 4.0), ("a", "x", 1.0)], "k string, t string, v double")
    right = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.5), ("b", "x", 3.5), (None, "x", 4.0), ("a", "x", 1.0)], "k string, t string, v double")
    found = fun.reconcile(left, right, ["k"])
    assert sorted((r.k, r.issue, r.left_value) for r in found.collect()) == [("a", "repeated", "3"), ("b", "value", "3.0")]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
