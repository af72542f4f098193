import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from quotemill.operators import coverage, day_maps
from quotemill.quality import checks, report
from quotemill.session import shared_dir, stored

BASE = dt.date(1969, 9, 20)  # words before and after the epoch, ends of words included


def _day(n):
    return BASE + dt.timedelta(n)


def _bars(spark, held):
    return spark.createDataFrame([(c, d) for c, d in held], "code string, day date")


def _random(seed):
    rnd = random.Random(seed)
    held = [(rnd.choice("ABC"), _day(rnd.randrange(300))) for _ in range(250)] + [("HOT", _day(5))] * 50
    held += [(None, _day(7)), ("A", None)]
    lives = [("A", _day(10), None), ("B", _day(70), _day(200)), ("C", None, None), ("D", _day(0), _day(400)),
             ("E", _day(290), _day(100)), ("HOT", _day(5), _day(6)), (None, _day(0), None)]
    return held, lives


def test_maps_give_the_days_back_and_merge(spark):
    held, _ = _random(1)
    bars = _bars(spark, held)
    want = sorted({(c, d) for c, d in held if c and d})
    maps = day_maps.day_maps(bars)
    assert rows(day_maps.days_of(maps)) == want
    loads = [day_maps.day_maps(bars.filter(F.crc32(F.col("day").cast("string")) % 3 == i)) for i in range(3)]
    assert rows(day_maps.merged(*loads, loads[0])) == rows(maps)
    assert rows(day_maps.merged(maps.limit(0))) == []


def test_missing_days_and_completeness_against_sets(spark):
    for seed in (2, 3):
        held, lives = _random(seed)
        bars = _bars(spark, held)
        sec = spark.createDataFrame(lives, "code string, start_date date, end_date date")
        have = {(c, d) for c, d in held if c and d}
        known = {d for _, d in have}
        gone = sorted((c, d) for c, a, b in lives if c and a for d in known
                      if a <= d and (b is None or d < b) and (c, d) not in have)
        assert rows(coverage.missing_trading_days(sec, bars)) == gone
        given = spark.createDataFrame([(d,) for d in sorted(known)[::2]], "day date")
        assert rows(coverage.missing_trading_days(sec, bars, given)) == [
            (c, d) for c, d in gone if d in set(sorted(known)[::2])]
        as_of, floor = _day(250), _day(3)
        last = max(d for d in known if d <= as_of)
        want = {}
        for c, a, b in lives:
            lo, hi = max(a or floor, floor), min(b or last, last)
            n = sum(lo <= d <= hi for d in known)
            k = sum(lo <= d <= hi for x, d in have if x == c)
            want[c] = (lo, hi, n, k, round(min(1.0, k / n), 6) if n else 1.0)
        got = coverage.completeness(sec, bars, None, as_of, floor)
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_no_bars_no_days(spark):
    bars = _bars(spark, []).limit(0)
    sec = spark.createDataFrame([("A", _day(1), None)], "code string, start_date date, end_date date")
    assert rows(coverage.missing_trading_days(sec, bars)) == []
    assert rows(coverage.completeness(sec, bars, None, _day(9)), "expected_days", "completeness") == [(0, 1.0)]


def test_one_scan_of_the_bars_is_shuffled_once(spark, market):
    """The calendar and the held days come from one shuffle of the bars' table."""
    path = f"{shared_dir(spark, 'bars')}/rows"
    market.bars_ev.select("code", "day").write.parquet(path)
    out = coverage.missing_trading_days(market.securities, spark.read.parquet(path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1, plan


def test_a_security_does_not_walk_over_the_calendar(spark):
    rnd = random.Random(9)
    known = sorted({_day(rnd.randrange(900)) for _ in range(200)} | {_day(4000)})  # words without days between
    spans = [(i, _day(rnd.randrange(-200, 4300)), _day(rnd.randrange(-200, 4300))) for i in range(300)]
    spans += [(300, None, _day(5)), (301, _day(5), None), (302, known[0], known[0]), (303, _day(5), _day(4))]
    frame = spark.createDataFrame(spans, "i int, a date, b date")
    for days, as_of in ((known, _day(100)), ([], _day(100)), (known, _day(-300))):
        calendar = spark.createDataFrame([(d,) for d in days], "day date")
        got = frame.withColumn("c", day_maps.counted_calendar(calendar, F.lit(as_of))).select(
            "i", day_maps.calendar_days_in(F.col("c"), F.col("a"), F.col("b")).alias("n"), "c.newest").collect()
        want = {i: sum(a <= d <= b for d in days) if a and b else 0 for i, a, b in spans}
        assert {r.i: r.n for r in got} == want
        assert {r.newest for r in got} == {max((d for d in days if d <= as_of), default=None)}
    held, lives = _random(4)
    sec = spark.createDataFrame(lives, "code string, start_date date, end_date date")
    low = coverage.completeness(sec, _bars(spark, held), None, _day(250), _day(3)).filter("expected_days > 0")
    assert "aggregate(" not in low._jdf.queryExecution().optimizedPlan().toString()


def test_issues_of_incomplete_series_can_be_ranked(spark):
    """The rank is filtered below the scalars; the calendar's held there as a join of its words with themselves."""
    sec = stored(spark.createDataFrame([("A", _day(0), None), ("B", _day(0), None)], "code string, start_date date, end_date date")
                 .withColumns({"update_date": F.lit(BASE), "status": F.lit("normal")}), "ranked")
    maps = stored(day_maps.day_maps(_bars(spark, [("A", _day(i)) for i in range(0, 900, 90)] + [("B", _day(0))])), "ranked")
    low = checks.series_completeness(sec, maps, None, _day(900), 5, floor=BASE)
    top = report.top_issues(low.unionByName(checks.table_empty(maps.limit(0), "price_data")))
    assert [tuple(r) for r in top.select("severity", "check_name", "count", "samples").collect()] == [
        ("critical", "table_not_empty", 0, []), ("warning", "time_series_completeness", 1, ["B(10.00%)"])]
    top = report.top_issues(low.unionByName(checks.table_empty(maps, "price_data")))
    assert [r.check_name for r in top.collect()] == ["time_series_completeness"]
