import datetime as dt
import glob
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import fundamentals, merge
from quotemill.session import shared_dir

D = dt.date(2020, 1, 1)


def _table(spark, data, schema="k string, v int, y int"):
    path = f"{shared_dir(spark, 'touched')}/rows"
    merge.write_partitions(spark.createDataFrame(data, schema), path, ["y"])
    return path


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/y=*/*.parquet")}


def test_upsert_writes_only_the_folders_of_its_keys(spark):
    path = _table(spark, [("a", 1, 2001), ("b", 1, 2002), ("c", 1, 2003), ("d", 1, None), ("e", 1, 2004)])
    before = _files(path)
    new = spark.createDataFrame([("a", 5, 2001, 2), ("a", 9, 2001, 1), ("b", 7, 2003, 1), ("f", 1, 2005, 1),
                                 ("d", 2, None, 1)], "k string, v int, y int, seq int")
    for _ in range(2):  # a batch that runs again changes nothing more
        touched = merge.upsert_stored(path, new, ["k"], ["seq"], "y")
        assert rows(spark.read.parquet(path), "k", "v", "y") == [
            ("a", 5, 2001), ("b", 7, 2003), ("c", 1, 2003), ("d", 2, None), ("e", 1, 2004), ("f", 1, 2005)]
        assert set(touched) <= {2001, 2002, 2003, 2005, None}
    assert not os.path.exists(f"{path}/y=2002")  # nothing is left of it
    same = {f for f, t in _files(path).items() if before.get(f) == t}
    assert same == {f for f in before if "/y=2004/" in f}


def test_upsert_with_the_folder_in_the_key_reads_no_other_folder(spark):
    path = _table(spark, [("a", 1, 2001), ("a", 1, 2002)])
    new = spark.createDataFrame([("a", 2, 2002)], "k string, v int, y int")
    assert merge.upsert_stored(path, new, ["k", "y"], ["v"], "y") == [2002]
    assert rows(spark.read.parquet(path), "k", "v", "y") == [("a", 1, 2001), ("a", 2, 2002)]
    assert merge.upsert_stored(path, new.limit(0), ["k", "y"], ["v"], "y") == []


def test_delete_and_update_stored(spark):
    path = _table(spark, [("a", 1, 2001), ("b", 1, 2001), ("a", 1, 2002), (None, 1, 2003)])
    before = _files(path)
    assert merge.delete_stored(spark, path, "y", k="a", y=2002) == [2002]
    assert merge.update_stored(spark, path, "y", {"v": 4}, k="a") == [2001]
    assert merge.delete_stored(spark, path, "y", k="zz") == []
    assert rows(spark.read.parquet(path), "k", "v", "y") == [("a", 4, 2001), ("b", 1, 2001), (None, 1, 2003)]
    assert {f for f, t in _files(path).items() if before.get(f) == t} == {f for f in before if "/y=2003/" in f}
    with pytest.raises(ValueError):
        merge.delete_stored(spark, path, "y")
    with pytest.raises(ValueError):
        merge.update_stored(spark, path, "y", {"y": 1}, k="a")


def _diff(spark, left, right, **more):
    schema = "k string, v double, y int"
    out = merge.content_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "y",
                             leaves=8, **more)
    return {r.k: (r.left_rows, r.right_rows, r.state) for r in out.collect()}


def test_contents_differ_by_value_null_repeat_and_range(spark):
    same = [(f"s{i}", float(i), 2000 + i % 3) for i in range(40)]
    left = same + [("a", 1.0, 2001), ("b", None, 2001), ("c", 1.0, 2002), ("r", 1.0, 2000), ("r", 1.0, 2000),
                   ("m", 3.0, None), (None, 1.0, 2000), ("swap", 1.0, 2001), ("swap", 2.0, 2001)]
    right = list(reversed(same)) + [("a", 1.5, 2001), ("b", 0.0, 2001), ("c", 1.0, 2003), ("r", 1.0, 2000),
                                    ("x", 3.0, None), (None, 2.0, 2000), ("swap", 2.0, 2001), ("swap", 1.0, 2001)]
    assert _diff(spark, left, right) == {
        "a": (1, 1, "changed"), "b": (1, 1, "changed"), "c": (1, 1, "changed"), "r": (2, 1, "changed"),
        "m": (1, 0, "missing"), "x": (0, 1, "extra"), None: (1, 1, "changed")}
    assert _diff(spark, left, list(reversed(left))) == {} == _diff(spark, [], [])


def test_kept_sums_spare_the_ranges_that_agree(spark):
    schema = "k string, v double, y int"
    data = [(f"k{i}", float(i), 2000 + i % 4) for i in range(200)]
    old, new = _table(spark, data, schema), _table(spark, [(k, v + (k == "k6"), y) for k, v, y in data], schema)
    a, b = spark.read.parquet(old), spark.read.parquet(new)
    sums = merge.content_sums(a, ["k"], "y")
    assert sums.agg(F.sum("n")).first()[0] == 200
    out = merge.content_diff(a, b, ["k"], "y", left_sums=sums)
    assert rows(out, "k", "state") == [("k6", "changed")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/touched-" in x]
    assert scans and all("y#" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans)


def test_known_statement_against_a_search_through_all(spark):
    rnd = random.Random(5)
    quarters = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]
    st = [(rnd.choice("AB"), rnd.choice(quarters), rnd.choice([None, 0, 1]), D + dt.timedelta(rnd.randrange(700)),
           float(i)) for i in range(60)]
    st += [("A", quarters[0], 1, None, 99.0), (None, quarters[0], 1, D, 98.0)]
    bars = [(rnd.choice("ABC"), D + dt.timedelta(rnd.randrange(900)), i) for i in range(300)]
    bars += [("A", None, 1000), (None, D, 1001), ("A", D + dt.timedelta(400), 1002), ("A", D + dt.timedelta(400), 1003)]
    s = spark.createDataFrame(st, "code string, stat_date date, report_type int, pub_date date, v double")
    b = spark.createDataFrame(bars, "code string, day date, id int")
    rank = lambda x: (x[1], -1 if x[2] is None else x[2], x[3], x[4])
    want = {}
    for c, d, i in bars:
        known = [x for x in st if c and d and x[0] == c and x[3] and x[3] <= d]
        want[i] = max(known, key=rank)[4] if known else None
    out = fundamentals.with_known_statement(b, s)
    got = {r.id: r.v for r in out.select("id", F.col("statement.v").alias("v")).collect()}
    assert out.count() == len(bars) and got == want
    assert fundamentals.with_known_statement(b.limit(0), s).count() == 0
    assert rows(fundamentals.with_known_statement(b, s.limit(0)).filter("statement IS NOT NULL"), "id") == []


def test_sums_are_not_compared_in_one_task(spark, monkeypatch):
    written = []
    keep = merge.stored
    monkeypatch.setattr(merge, "stored", lambda df, purpose, files=None: written.append((files, df)) or keep(df, purpose, files))
    left = spark.createDataFrame([("a", 1, 1.0, 2020), ("b", 1, 2.0, 2021)], "code string, day int, close double, part_year int")
    right = spark.createDataFrame([("a", 1, 1.0, 2020), ("b", 1, 2.5, 2021)], left.schema)
    found = merge.content_diff(left, right, ["code", "day"], "part_year").collect()
    assert [(r.code, r.state) for r in found] == [("b", "changed")]
    (files, leaves), = written
    assert files is None and "Coalesce" not in leaves._jdf.queryExecution().executedPlan().toString()
