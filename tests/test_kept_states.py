import glob
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import kept_states as ks
from quotemill.operators import merge, series
from quotemill.operators.handed_on import with_previous
from quotemill.session import shared_dir

SCHEMA = "k string, v double, at int, y int"
KEPT = ks.Figures(keys=("k",), folder="y", counts={"n": "v"}, sums={"s": "v"}, least={"lo": "at"},
                  greatest={"hi": "at"}, newest={"last": ["at", "v"]})


def _drawn(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "c", None]), r.choice([None, 0.1, 0.2, -3.25]), r.randrange(50),
             r.choice([2001, 2002, 2003, None])) for _ in range(n)]


def _expected(data):
    out = []
    for k in {d[0] for d in data}:
        mine = [d for d in data if d[0] == k]
        vs = [d[1] for d in mine if d[1] is not None]
        top = max(mine, key=lambda d: (d[2], d[1] is not None, d[1] or 0))
        out.append((k, len(mine), len(vs), round(sum(vs), 4) if vs else None, min(d[2] for d in mine),
                    max(d[2] for d in mine), top[2], top[1]))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def _now(spark, path):
    states = spark.read.parquet(path)
    f = ks.figures(states, KEPT)
    got = f.select("k", "_rows", "n", F.round("s", 4).alias("s"), "lo", "hi", "last.at", "last.v")
    return rows(got)


def test_states_after_loads_and_a_deletion_equal_the_whole_query(spark):
    base, path = (f"{shared_dir(spark, 'kept')}/{n}" for n in ("table", "states"))
    data = []
    for load in range(1, 6):
        batch = _drawn(40, load)
        df = spark.createDataFrame(batch, SCHEMA)
        merge.append(df, base, ["y"])
        data += batch
        ks.add_load(path, df, KEPT, load)
        assert _now(spark, path) == _expected(data)
        assert ks.add_load(path, df, KEPT, load) == []  # a load that runs again adds nothing
        assert _now(spark, path) == _expected(data)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/y=*/*.parquet")}
    assert ks.delete_rows(base, path, spark, KEPT, y=2002, k="a") == [2002]
    data = [d for d in data if not (d[0] == "a" and d[3] == 2002)]
    assert _now(spark, path) == _expected(data)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/y=*/*.parquet")}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "/y=2002/" not in f}
    ks.add_load(path, spark.createDataFrame(_drawn(9, 77), SCHEMA), KEPT, 6)
    assert _now(spark, path) == _expected(data + _drawn(9, 77))


def test_a_load_that_failed_halfway_runs_again(spark):
    path = f"{shared_dir(spark, 'kept')}/states"
    df = spark.createDataFrame([("a", 1.0, 1, 2001), ("a", 2.0, 2, 2002)], SCHEMA)
    ks.add_load(path, df.where("y = 2001"), KEPT, 1)  # as if only one folder had been reached
    assert ks.add_load(path, df, KEPT, 1) == [2002]
    assert _now(spark, path) == [("a", 2, 2, 3.0, 1, 2, 2, 2.0)]


def test_empty_load_and_emptied_folder(spark):
    base, path = (f"{shared_dir(spark, 'kept')}/{n}" for n in ("table", "states"))
    df = spark.createDataFrame([("a", 1.0, 1, 2001), ("b", 2.0, 2, 2002)], SCHEMA)
    assert ks.add_load(path, df.limit(0), KEPT, 1) == []
    merge.append(df, base, ["y"])
    ks.add_load(path, df, KEPT, 2)
    ks.delete_rows(base, path, spark, KEPT, y=2002)
    assert _now(spark, path) == [("a", 1, 1, 1.0, 1, 1, 1, 1.0)]
    assert not os.path.exists(f"{path}/y=2002")


@pytest.mark.parametrize("n", [1, 3, 16])
def test_previous_row_against_brute_force(spark, n):
    r = random.Random(n)
    data = {(r.choice([None, None, None, "a", "b", "c"]), r.choice([None, *range(40)]), float(r.randrange(30)))
            for _ in range(900)}
    df = spark.createDataFrame(list(data), "k string, d int, v double")
    got = with_previous(df, ["k"], ["d", "v"], "v", "before", ranges=n)
    expected, last = [], {}
    for k, d, v in sorted(data, key=lambda t: (t[0] or "", t[1] is not None, t[1] or 0, t[2])):
        expected.append((k, d, v, last.get(k)))
        last[k] = v
    assert rows(got) == sorted(expected, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert with_previous(df.limit(0), ["k"], ["d", "v"], "v", "before").collect() == []


def test_a_key_of_half_of_all_rows_is_dealt_evenly(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 997).cast("string").alias("k"),
                                    F.xxhash64("id").alias("d"))
    dealt = df.repartitionByRange(16, "k", "d").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = sorted(r["count"] for r in dealt.collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_moves_of_clean_rows_are_the_same_either_way(spark, market):
    bars = market.bars_li
    one = series.abnormal_moves(bars, "1998-12-01", days=None)
    two = series.abnormal_moves_of_dirty_rows(bars, "1998-12-01", days=None)
    shown = ["code", "day", "close", "prev_close", F.round("change_ratio", 9).alias("c")]
    assert rows(one.select(*shown)) == rows(two.select(*shown))


def test_loads_are_dealt_from_one_reading(spark, market):
    from quotemill.plans import load_queries

    drawn = spark.range(500).select(F.expr("uuid()").alias("k"), F.lit(1.0).alias("v"), F.lit(1).alias("at"),
                                    F.lit("2001-02-03").cast("date").alias("day"))  # other ids each time it is read
    kept = ks.Figures(keys=("k",), folder="part_year", counts={"n": "v"})
    table, states = load_queries._five_loads(market, drawn, "day", kept)
    ids = {r.k for r in spark.read.parquet(table).select("k").collect()}
    assert len(ids) == 500 == spark.read.parquet(table).count()
    assert {r.k for r in spark.read.parquet(states).select("k").collect()} == ids


def test_a_lot_lands_in_as_many_files_as_it_fills(spark, market):
    from quotemill.plans import stream_queries

    landed = f"{shared_dir(spark, 'lots')}/landed"
    rows_in = spark.range(400, numPartitions=4).select("id", F.when(F.col("id") > 9, F.col("id") % 2).alias("part"))
    seen = []
    for stream in stream_queries._lots(market, rows_in, [F.col("part") == 0, F.col("part") == 1, F.col("part").isNull()], landed):
        assert stream.isStreaming
        seen.append((len(glob.glob(f"{landed}/*.parquet")), spark.read.schema(rows_in.schema).parquet(landed).count()))
    assert [n for _, n in seen] == [195, 390, 400] and seen[0][0] > 1 and seen[1][0] - seen[0][0] > 1
