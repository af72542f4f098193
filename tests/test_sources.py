import datetime as dt
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.schemas import KEYS, SCHEMAS
from quotemill.session import shared_dir
from quotemill.sources import account_files as af
from quotemill.sources import landed, tables
from quotemill.streaming import account_streams as st

D = dt.date(2024, 1, 10)


def put(base, user, kind, name, content):
    folder = f"{base}/account/{user}/{kind}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))


@pytest.fixture(scope="module")
def trade_dir(spark):
    base = shared_dir(spark, "trade-files")
    put(base, "111", "trades_orders", "20240110.json", {"trades": [
        {"TradeId": "t1", "TradeTime": "09:31:00", "Code": "600000.SH", "TradeType": 23, "Volume": 100,
         "Price": 10.0, "Value": 1000.0, "Commission": 1.0, "Tax": 0.0, "Remark": "str1_600000.SH"},
        {"TradeTime": "bad", "证券代码": "000001.SZ", "TradeType": 24, "成交数量": 50, "成交均价": 2.0,
         "成交金额": 100.0, "订单编号": "o9"},
        {"TradeId": "t3", "StockCode": "NOPE", "Quantity": 0, "TradePrice": 1.0}]})
    put(base, "111", "trades_orders", "20240111.json", {"trades": []})
    put(base, "222", "trades_orders", "20240110.json", {"orders": []})
    put(base, "222", "trades_orders", "notes.json", {"trades": []})
    put(base, "222", "trades_orders", "20240112.json", '{"trades": [')
    put(base, "demo", "trades_orders", "20240110.json", {"trades": []})
    return base


def test_trade_files(spark, trade_dir):
    files = af.trade_files(spark, f"{trade_dir}/account/*/trades_orders/*.json")
    bad = {os.path.basename(os.path.dirname(os.path.dirname(p))) + "/" + os.path.basename(p): why
           for p, why in rows(af.rejected_files(files))}
    assert bad == {"222/20240110.json": "no trades list", "222/notes.json": "file name is not YYYYMMDD.json",
                   "222/20240112.json": "malformed JSON", "demo/20240110.json": "no account number in the path"}
    t = {r.stock_code: r for r in af.trades_from(files).collect()}
    a, b = t["600000.SH"], t["000001.SZ"]
    assert (a.trade_id, a.user_id, a.trade_date, a.quantity, a.amount, a.strategy_id) == (
        "t1", "111", D, 100.0, 1000.0, "str1")
    assert a.trade_time == dt.datetime(2024, 1, 10, 9, 31) and b.trade_time == dt.datetime(2024, 1, 10)
    assert (b.quantity, b.price, b.amount, b.order_id, b.trade_type) == (50.0, 2.0, 100.0, "o9", 24)
    assert b.trade_id.startswith("111_")
    report = af.trade_file_report(files)
    ok = report.filter("reject_reason IS NULL").orderBy("file_date").collect()
    assert [(r.n_rows, r.n_valid, r.n_invalid) for r in ok] == [(3, 2, 1), (0, 0, 0)]
    assert tuple(af.directory_totals(report).first()) == (6, 4, 3, 2, 2)


def test_bundled_files_read_as_loose_ones(spark, trade_dir):
    loose = f"{trade_dir}/account/*/trades_orders/*.json"
    bundle = f"{shared_dir(spark, 'bundle')}/trades.bundle"
    af.bundle_files(spark, loose, bundle)
    files = [af.trade_files(spark, p) for p in (loose, bundle)]
    assert rows(af.rejected_files(files[1])) == rows(af.rejected_files(files[0])) and files[1].count() == 6
    assert rows(af.trades_from(files[1])) == rows(af.trades_from(files[0]))
    assert rows(af.trade_file_report(files[1])) == rows(af.trade_file_report(files[0]))
    assert rows(files[1].select("file_path", "modified")) == rows(files[0].select("file_path", "modified"))
    with pytest.raises(ValueError, match="bundle"):
        af.write_bundle(files[0], "trades")


def test_file_queries_land_no_file_per_account(spark, market):
    from quotemill.plans import source_queries as sq

    accounts = market.ledger.select("user_id").distinct().count()
    for path in (sq._trade_tree(market), sq._position_tree(market, sq._holdings(market), shared_dir(spark, "few"))):
        names = [n for _, _, files in os.walk(os.path.dirname(path)) for n in files if n.endswith((".json", ".parquet"))]
        assert 0 < len(names) <= 8 < accounts


def holding(code, qty, value, frozen=0):
    return {"证券代码": code, "持仓数量": qty, "可用数量": qty - frozen, "冻结数量": frozen, "开仓价格": 1.0,
            "持仓市值": value}


ACCOUNT = {"总资产": 100.0, "持仓市值": 60.0, "可用资金": 40.0}


def test_position_files(spark):
    base = shared_dir(spark, "position-files")
    put(base, "111", "account_positions", "20240110.json", {
        "timestamp": "2024-01-10 15:01:02", "account_info": ACCOUNT,
        "positions": [holding("600000.SH", 10, 20.0), holding("000001.SZ", 5, 10.0, 9)]})
    put(base, "222", "account_positions", "20240110.json", {"positions": []})
    files = af.position_files(spark, f"{base}/account/*/account_positions/*.json")
    p = {r.stock_code: r for r in af.positions_from(files).collect()}
    assert p["600000.SH"].position_id == "POS_111_20240110_600000.SH"
    assert (p["600000.SH"].current_price, p["600000.SH"].unrealized_pnl, p["600000.SH"].unrealized_pnl_ratio) == (2.0, 10.0, 1.0)
    assert p["600000.SH"].timestamp == dt.datetime(2024, 1, 10, 15, 1, 2)
    acc = af.accounts_from(files).collect()
    assert [(r.user_id, r.info_date, r.total_assets, r.frozen_cash) for r in acc] == [("111", D, 100.0, 0.0)]
    report = {r.user_id: (r.n_rows, r.n_valid, r.account_present) for r in af.position_file_report(files).collect()}
    assert report == {"111": (2, 1, True), "222": (0, 0, False)}
    assert af.position_files(spark, f"{base}/account/*/account_positions/*.json", ["222"]).count() == 1


def test_trade_stream_equals_batch_and_resumes(spark):
    base = shared_dir(spark, "trade-stream")

    def drop(day, *ids):
        put(base, "111", "trades_orders", f"{day}.json", {"trades": [
            {"TradeId": i, "TradeTime": "10:00:00", "Code": "600000.SH", "Volume": 1, "Price": 1.0, "Value": 1.0}
            for i in ids]})

    def step():
        stream = st.trade_file_stream(spark, f"{base}/account/*/trades_orders")
        st.run(st.append_trades(stream, f"{base}/table", f"{base}/checkpoint"))
        return rows(spark.read.parquet(f"{base}/table"), "trade_id")

    drop("20240110", "a", "b", "b")
    assert step() == [("a",), ("b",)]
    drop("20240111", "b", "c")
    drop("20240301", "a", "d")
    assert step() == [("a",), ("b",), ("c",), ("d",)]
    assert step() == [("a",), ("b",), ("c",), ("d",)]


def test_position_stream_replaces_account_days(spark):
    base = shared_dir(spark, "position-stream")

    def drop(user, *holdings):
        put(base, user, "account_positions", "20240110.json", {"account_info": ACCOUNT, "positions": list(holdings)})

    def step(n):
        stream = st.position_file_stream(spark, f"{base}/account/*/account_positions")
        st.run(st.replace_snapshots(stream, f"{base}/table", f"{base}/checkpoint{n}"))
        return rows(spark.read.parquet(f"{base}/table"), "user_id", "stock_code", "position_quantity")

    drop("111", holding("A.SH", 1, 1.0), holding("B.SH", 2, 1.0))
    drop("222", holding("C.SH", 3, 1.0))
    assert step(1) == [("111", "A.SH", 1), ("111", "B.SH", 2), ("222", "C.SH", 3)]
    drop("111", holding("A.SH", 9, 1.0))
    assert step(2) == [("111", "A.SH", 9), ("222", "C.SH", 3)]


def test_position_stream_of_bundles(spark):
    base = shared_dir(spark, "bundle-stream")

    def land(*files):
        texts = [(f"/in/account/{user}/account_positions/20240110.json", at,
                  json.dumps({"positions": [holding(*h) for h in held]}, ensure_ascii=False)) for user, at, held in files]
        df = spark.createDataFrame(texts, "path string, at long, text string")
        af.write_bundle(df.select("path", F.timestamp_seconds("at").alias("modificationTime"), F.length("text").cast("long").alias("length"),
                                  F.col("text").cast("binary").alias("content")), f"{base}/in.bundle")

    def step():
        st.run(st.replace_snapshots(st.position_file_stream(spark, f"{base}/in.bundle"), f"{base}/table", f"{base}/checkpoint"))
        return rows(spark.read.parquet(f"{base}/table"), "user_id", "stock_code", "position_quantity")

    land(("111", 10, [("A.SH", 1, 1.0)]), ("111", 20, [("A.SH", 2, 1.0)]), ("222", 10, [("B.SH", 3, 1.0)]))
    assert step() == [("111", "A.SH", 2), ("222", "B.SH", 3)]  # of one file landed twice the newer counts
    land(("111", 15, [("A.SH", 9, 1.0)]), ("222", 30, [("C.SH", 4, 1.0)]))
    assert step() == [("111", "A.SH", 2), ("222", "C.SH", 4)]


def test_a_batch_of_position_files_is_parsed_once_and_written_adaptively(spark, monkeypatch):
    base, written = shared_dir(spark, "parsed-once"), []
    write = st.merge.write_partitions

    def watched(df, *args):
        written.append((df.sparkSession.conf.get("spark.sql.adaptive.enabled"), df._jdf.queryExecution().optimizedPlan().toString()))
        write(df, *args)

    monkeypatch.setattr(st.merge, "write_partitions", watched)
    text = json.dumps({"positions": [holding("A.SH", 1, 1.0)]}, ensure_ascii=False)
    df = spark.createDataFrame([("/in/account/111/account_positions/20240110.json", text)], "path string, text string")
    af.write_bundle(df.select("path", F.timestamp_seconds(F.lit(10)).alias("modificationTime"), F.length("text").cast("long").alias("length"),
                              F.col("text").cast("binary").alias("content")), f"{base}/in.bundle")
    st.run(st.replace_snapshots(st.position_file_stream(spark, f"{base}/in.bundle"), f"{base}/table", f"{base}/checkpoint"))
    assert rows(spark.read.parquet(f"{base}/table"), "user_id", "stock_code") == [("111", "A.SH")]
    (adaptive, plan), = written
    assert adaptive == "true" and "from_json" not in plan


def test_a_batch_names_its_folders_and_leaves_no_parsed_files(spark, monkeypatch):
    base, plans, dirs = shared_dir(spark, "batch-disk"), [], []
    write, fresh = st.merge.write_partitions, st.shared_dir
    monkeypatch.setattr(st.merge, "write_partitions",
                        lambda df, *args: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *args)))
    monkeypatch.setattr(st, "shared_dir", lambda *args: (dirs.append(fresh(*args)), dirs[-1])[1])
    stream = st.position_file_stream(spark, f"{base}/account/*/account_positions")
    for n, files in enumerate(([("111", "20240110", 1), ("222", "20240110", 2), ("222", "20240111", 3)], [("111", "20240110", 9)])):
        for user, day, q in files:
            put(base, user, "account_positions", f"{day}.json", {"account_info": ACCOUNT, "positions": [holding("A.SH", q, 1.0)]})
        st.run(st.replace_snapshots(stream, f"{base}/table", f"{base}/checkpoint{n}"))
    assert rows(spark.read.parquet(f"{base}/table"), "user_id", "position_quantity") == [("111", 9), ("222", 2), ("222", 3)]
    assert len(dirs) == 2 and not any(names for d in dirs for _, _, names in os.walk(d))
    # the table's rows meet the batch once, by pair; its folders are not looked for in a join
    assert plans[1].count("LeftAnti") == 1 and not [x for x in plans[1].split("\n") if "LeftSemi" in x and "position_date" in x], plans[1]


def test_position_stream_empty_and_late_files(spark):
    base = shared_dir(spark, "position-late")
    clock = iter(range(1_700_000_000, 1_800_000_000, 1000))

    def drop(user, day, *holdings, at=None):
        put(base, user, "account_positions", f"{day}.json", {"account_info": ACCOUNT, "positions": list(holdings)})
        os.utime(f"{base}/account/{user}/account_positions/{day}.json", (at or next(clock),) * 2)

    def step(n):
        stream = st.position_file_stream(spark, f"{base}/account/*/account_positions")
        st.run(st.replace_snapshots(stream, f"{base}/table", f"{base}/checkpoint{n}"))
        return rows(spark.read.schema(SCHEMAS["user_positions"]).parquet(f"{base}/table"), "user_id", "stock_code",
                    "position_quantity")

    drop("111", "20240110", holding("A.SH", 1, 1.0))
    drop("222", "20240111", holding("B.SH", 2, 1.0))
    assert step(1) == [("111", "A.SH", 1), ("222", "B.SH", 2)]
    drop("111", "20240110")  # newer and empty: its day goes, the other day stays
    assert step(2) == [("222", "B.SH", 2)]
    drop("111", "20240110", holding("C.SH", 3, 1.0), at=1_600_000_000)  # older than the empty one
    drop("222", "20240111", holding("B.SH", 7, 1.0), at=1_600_000_000)
    assert step(3) == [("222", "B.SH", 2)]
    assert step(3) == [("222", "B.SH", 2)]
    drop("333", "20240110", holding("D.SH", 4, 1.0))
    assert step(4) == [("222", "B.SH", 2), ("333", "D.SH", 4)]


def test_trade_stream_keyed_by_date_reads_only_touched_days(spark):
    base = shared_dir(spark, "trade-dates")

    def step(day, *ids):
        put(base, "111", "trades_orders", f"{day}.json", {"trades": [
            {"TradeId": i, "TradeTime": "10:00:00", "Code": "600000.SH", "Volume": 1, "Price": 1.0, "Value": 1.0}
            for i in ids]})
        stream = st.trade_file_stream(spark, f"{base}/account/*/trades_orders")
        st.run(st.append_trades(stream, f"{base}/table", f"{base}/cp-{len(ids)}", keys=("trade_id", "trade_date")))
        return rows(spark.read.parquet(f"{base}/table"), "trade_id", "trade_date")

    d10, d11 = dt.date(2024, 1, 10), dt.date(2024, 1, 11)
    assert step("20240110", "a", "b", "b") == [("a", d10), ("b", d10)]
    assert step("20240110", "a", "c") == [("a", d10), ("b", d10), ("c", d10)]
    assert step("20240111", "a") == [("a", d10), ("a", d11), ("b", d10), ("c", d10)]


def test_near_repeats_are_dropped_with_bounded_state(spark):
    base = shared_dir(spark, "repeats")
    put(base, "111", "trades_orders", "20240110.json", {"trades": [{"TradeId": i, "TradeTime": "10:00:00"} for i in "aab"]})
    stream = st.drop_repeats(st.trade_file_stream(spark, f"{base}/account/*/trades_orders"))
    st.run(st._available(stream.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/cp"))
    assert rows(spark.read.parquet(f"{base}/out"), "trade_id") == [("a",), ("b",)]


def test_align_to_schema(spark):
    df = spark.createDataFrame([("600000.SH", "20240110", "x", 1, 5.0, 6.0)],
                               "code string, day string, open string, extra int, close double, dup double") \
        .toDF("code", "day", "open", "extra", "close", "close")
    out = landed.align_to_schema(df, "price_data")
    assert out.schema.fieldNames() == SCHEMAS["price_data"].fieldNames()
    r = out.first()
    assert (r.code, r.day, r.open, r.close, r.volume) == ("600000.SH", D, None, 5.0, None)
    diff = dict(rows(landed.schema_diff(df, "price_data")))
    assert (diff["extra"], diff["volume"], diff["close"]) == ("extra", "missing", "common")


def test_price_feeds(spark):
    raw = spark.createDataFrame([("430001.BSE", "20240110", 1.0, 2.0, 10.0, 20.0)],
                                "ts_code string, trade_date string, open double, close double, vol double, amount double")
    r = landed.price_feed(raw).first()
    assert (r.code, r.day, r.volume, r.money, r.factor, r.paused) == ("430001.BJ", D, 10.0, 20.0, None, None)
    r = landed.price_feed(raw, pre_adjusted=True).first()
    assert (r.factor, r.adj_factor, r.adj_close, r.paused) == (1.0, 1.0, 2.0, 0)


def test_security_masters(spark):
    schema = "code string, display_name string, name string, start_date date, end_date date"
    far = dt.date(2200, 1, 1)
    stocks = spark.createDataFrame([("600001.XSHG", "ST one", "A", D, far)], schema)
    bj = spark.createDataFrame([("430001.BJSE", None, D)], "code string, display_name string, start_date date")
    got = {r.code: r for r in landed.security_master(stocks, bj, "2024-02-01").collect()}
    assert (got["600001.SH"].is_st, got["600001.SH"].end_date, got["600001.SH"].market) == (True, None, "main")
    assert (got["430001.BJ"].is_st, got["430001.BJ"].exchange, got["430001.BJ"].status) == (False, "BSE", "normal")
    i = landed.index_master(spark.createDataFrame([("000300.XSHG", "CSI", "C", D, far)], schema), "2024-02-01").first()
    assert (i.code, i.market, i.security_type, i.end_date, i.is_st) == ("000300.SH", None, "index", None, False)


def test_code_map_csv(spark):
    base = shared_dir(spark, "map")
    for name, head in (("named", "x,new_code,old_code"), ("plain", "a,b,c")):
        os.makedirs(f"{base}/{name}")
        with open(f"{base}/{name}/m.csv", "w") as f:
            f.write(f"{head}\n1,920001,430001\n")
    assert rows(landed.code_map(spark, f"{base}/named")) == [("430001", "920001")]
    assert rows(landed.code_map(spark, f"{base}/plain")) == [("1", "920001")]


def test_tables_round_trip_and_exports(spark):
    base = shared_dir(spark, "tables")
    df = spark.createDataFrame([("A.SH", D, 1.0), ("B.SH", dt.date(2023, 5, 5), float("nan"))],
                               "code string, day date, close double")
    full = landed.align_to_schema(df, "price_data")
    tables.write_table(full, base, "price_data")
    back = tables.read_table(spark, base, "price_data")
    assert rows(back, "code", "day") == [("A.SH", D), ("B.SH", dt.date(2023, 5, 5))]
    from quotemill.operators.scan import range_scan

    near = range_scan(back, start="2024-01-01", fields=["close"])
    assert rows(near, "code") == [("A.SH",)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "part_year" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    path = tables.snapshot(back, base, "price_data", "20240110")
    with pytest.raises(Exception):
        tables.snapshot(back, base, "price_data", "20240110")
    assert spark.read.parquet(path).count() == 2
    tables.export_csv(df, f"{base}/csv")
    assert spark.read.option("header", True).csv(f"{base}/csv").columns == ["code", "day", "close"]
    tables.export_json(df, f"{base}/json")
    text = [r.value for r in spark.read.text(f"{base}/json").collect()]
    assert any('"close":null' in t for t in text)
    info = {r.name: (r.type, r.not_null, r.primary_key) for r in tables.columns_of(df, "price_data").collect()}
    assert info == {"code": ("string", True, True), "day": ("date", True, True), "close": ("double", False, False)}


def test_sql_binds_values(spark):
    tables.register({"quotes": spark.createDataFrame([("a", 1), ("b' OR '1'='1", 2)], "k string, v int")})
    assert rows(tables.sql(spark, "SELECT v FROM quotes WHERE k = ?", ["b' OR '1'='1"])) == [(2,)]
    assert rows(tables.sql(spark, "SELECT v FROM quotes WHERE v >= :low", {"low": 2})) == [(2,)]


def test_schemas_have_their_keys():
    for table, keys in KEYS.items():
        assert set(keys) <= set(SCHEMAS[table].fieldNames()), table
    assert len(SCHEMAS) == 12


def test_conform_and_split(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "code string, short_term_loan double, total_liability_equity double")
    out = landed.conform_columns(df, None, landed.LEGACY_BALANCE_DROPPED, landed.LEGACY_BALANCE_RENAMES)
    assert out.columns == ["code", "shortterm_loan"]
    parts = landed.split_columns(df, ["code"], {"a": ["short_term_loan", "gone"], "b": []})
    assert (parts["a"].columns, parts["b"].columns) == (["code", "short_term_loan"], ["code"])


def test_numeric_feed(spark):
    df = spark.createDataFrame([("600000.XSHG", "1.5", "--")], "code string, eps string, roe string")
    assert rows(landed.numeric_feed(df)) == [("600000.SH", 1.5, None)]
    assert dict(landed.numeric_feed(df).dtypes)["roe"] == "double"
    s = landed.statement_feed(df.withColumn("report_date", F.lit("2024/01/10")))
    assert rows(s, "code", "stat_date") == [("600000.SH", D)]


def test_date_filters_skip_the_folders_of_other_years(spark, market):
    from quotemill.operators import calendar, coverage, ledger, merge, scan
    from quotemill.quality import checks

    base = shared_dir(spark, "years")
    px = market.bars_ev.select("code", "day", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume")])
    tables.write_table(px, base, "price_data")
    tables.write_table(px.select("code", "day", F.col("close").alias("market_cap")), base, "valuation_data")
    tables.write_table(market.positions, base, "user_positions")
    p, v = tables.read_table(spark, base, "price_data"), tables.read_table(spark, base, "valuation_data")
    held = tables.read_table(spark, base, "user_positions")
    sec, day, on = market.securities, "2024-01-10", ["2024-01-10", "2024-01-11"]
    plans = {
        "recent_breadth": checks.recent_breadth(p, day, 1), "day_coverage": checks.price_day_coverage(sec, p, on),
        "day_logic": checks.price_day_logic(p, on), "alignment": checks.daily_alignment(p, v, "valuation_data", days=on),
        "alignment_recent": checks.alignment_with_price(p, v, sec, day),
        "account_tables": checks.account_tables_on(on, positions=held), "recent": scan.recent(p, day, 90, "day"),
        "codes": coverage.codes_with_recent_data(p, day), "on_dates": coverage.rows_on_dates(p, on, "day"),
        "missing": coverage.missing_on_days(sec, p, on), "calendar": calendar.trading_calendar(p, start=day, end=day),
        "window": merge.batch_window(p.limit(0), p, day, full=True), "single": merge.batch_window(p, p, day, single_day=day),
        "book": ledger.position_book(held, day)}
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and base in line]
        assert scans and all("PartitionFilters: [isnotnull(part_year" in x or "PartitionFilters: [part_year" in x
                             for x in scans), (name, scans)
