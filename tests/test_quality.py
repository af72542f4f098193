import datetime as dt
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotemill.quality import checks, report, runner, sql_rules
from quotemill.quality.issues import counted_issue, first_samples
from quotemill.quality.rules import judge_rows, rules_at, standard_rules
from quotemill.session import shared_dir

AS_OF = "2024-01-31"
D0 = dt.date(2024, 1, 1)
LOW = {"max_volatile_moves": 1, "user_data_start_date": "2024-01-01", "min_active_securities": 2, "min_recent_codes": 2,
       "min_quarter_codes": 2, "max_extreme_prices": 1, "max_extreme_valuations": 1,
       "max_invalid_ratios": 1, "max_missing_valuations": 1}


@pytest.fixture(scope="module")
def clean(spark):
    days = [D0 + dt.timedelta(days=i) for i in range(31)]
    codes = ["600000.SH", "000001.SZ", "430001.BJ"]
    first = dt.date(2024, 1, 1)
    sec = spark.createDataFrame(
        [(c, c, first, None, e, "main", "normal") for c, e in zip(codes, ["XSHG", "XSHE", "BSE"])],
        "code string, display_name string, start_date date, end_date date, exchange string, market string, status string")
    px = spark.createDataFrame([(c, d, 10.0, 10.5, 9.8, 10.2, 100.0) for c in codes for d in days],
                               "code string, day date, open double, high double, low double, close double, volume double")
    val = px.select("code", "day", F.lit(1e9).alias("market_cap"), F.lit(12.0).alias("pe_ratio"),
                    F.lit(1.5).alias("pb_ratio"))
    ind = spark.createDataFrame([(c, dt.date(2024, 1, 20), dt.date(2023, 12, 31), 0.5, 0.1, 0.05) for c in codes],
                                "code string, pubDate date, statDate date, eps double, roe double, roa double")
    tr = spark.createDataFrame([(f"t{i}", "u", "600000.SH", d, 23, 10.0, 5.0, 50.0) for i, d in enumerate(days)],
                               "trade_id string, user_id string, stock_code string, trade_date date, trade_type int, "
                               "quantity double, price double, amount double")
    pos = spark.createDataFrame([("u", d, "600000.SH", 10, 10, 0, 5.0, 50.0) for d in days],
                                "user_id string, position_date date, stock_code string, position_quantity int, "
                                "available_quantity int, frozen_quantity int, current_price double, market_value double")
    acc = spark.createDataFrame([("u", d, 100.0, 50.0, 50.0, 0.0) for d in days],
                                "user_id string, info_date date, total_assets double, position_market_value double, "
                                "available_cash double, frozen_cash double")
    return {"stock_list": sec, "price_data": px, "valuation_data": val, "indicator_data": ind,
            "user_transactions": tr, "user_positions": pos, "user_account_info": acc}


def found(tables, level="standard"):
    issues = runner.run_checks(tables, AS_OF, level, thresholds=LOW)
    return {(r.table_name, r.check_name): r for r in issues.collect()}


def test_clean_tables_have_no_issues(clean):
    assert found(clean) == {}


def test_planted_faults_are_counted_exactly(clean):
    t = dict(clean)
    px, day = t["price_data"], F.dayofmonth("day")
    t["price_data"] = px.withColumns({
        "volume": F.when((day == 5), -1.0).otherwise(F.col("volume")),
        "open": F.when((day == 6) & F.col("code").endswith("SH"), None).otherwise(F.col("open")),
        "close": F.when(day.isin(20) & F.col("code").endswith("SZ"), 20.0).otherwise(F.col("close"))})
    tr = t["user_transactions"]
    t["user_transactions"] = tr.withColumns({
        "trade_type": F.when(F.col("trade_id") == "t1", 99).otherwise(F.col("trade_type")),
        "quantity": F.when(F.col("trade_id") == "t2", 0.0).otherwise(F.col("quantity")),
        "amount": F.when(F.col("trade_id").isin("t3", "t4"), 60.0).otherwise(F.col("amount")),
        "stock_code": F.when(F.col("trade_id") == "t5", "1.SH").otherwise(F.col("stock_code"))}) \
        .unionByName(tr.limit(2))
    pos = t["user_positions"]
    t["user_positions"] = pos.filter(~F.dayofmonth("position_date").between(10, 18)).withColumn(
        "available_quantity", F.when(F.dayofmonth("position_date") == 3, 11).otherwise(F.col("available_quantity")))
    t["user_account_info"] = t["user_account_info"].withColumn(
        "total_assets", F.when(F.dayofmonth("info_date") == 3, 110.01)
        .when(F.dayofmonth("info_date") == 4, 110.0).otherwise(F.col("total_assets")))
    got = {k: r["count"] for k, r in found(t).items()}
    assert got == {
        ("price_data", "price_logic_validation"): 3,
        ("price_data", "required_fields_not_null_open"): 1,
        ("price_data", "price_range_validation"): 1,
        ("price_data", "price_bracket_validation"): 1,
        ("price_data", "abnormal_volatility"): 1,
        ("user_transactions", "trade_type_validation"): 1,
        ("user_transactions", "quantity_price_validation"): 1,
        ("user_transactions", "amount_calculation_accuracy"): 2,
        ("user_transactions", "primary_key_unique"): 2,
        ("user_transactions", "stock_code_reference_integrity"): 1,
        ("user_positions", "position_quantity_logic"): 1,
        ("user_positions", "position_continuity_check"): 1,
        ("user_positions", "trading_day_completeness"): 9,
        ("user_account_info", "asset_balance_check"): 1,
        ("user_account_info", "account_value"): 9,  # no holdings left on the days 10 to 18
    }


def test_breadth_and_series_issues(clean):
    t = dict(clean)
    t["price_data"] = clean["price_data"].filter("NOT (code LIKE '%.BJ' AND day > DATE '2024-01-20')")
    t["valuation_data"] = clean["valuation_data"].filter("day < DATE '2024-01-31'")
    low = {**LOW, "min_recent_codes": 3, "min_active_securities": 4, "min_quarter_codes": 4}
    got = {(r.table_name, r.check_name): r for r in runner.run_checks(t, AS_OF, thresholds=low).collect()}
    assert {k: r["count"] for k, r in got.items()} == {
        ("price_data", "time_series_completeness"): 1, ("price_data", "recent_data_availability"): 2,
        ("stock_list", "active_stocks_coverage"): 3, ("indicator_data", "quarterly_data_completeness"): 3,
        ("valuation_data", "data_alignment_with_price"): 2}
    assert got[("price_data", "time_series_completeness")].samples == ["430001.BJ(64.52%)"]


def test_empty_table_and_level(clean):
    t = {"price_data": clean["price_data"].limit(0)}
    got = {r.check_name for r in runner.run_checks(t, AS_OF, "quick", thresholds=LOW).collect()}
    assert got == {"table_not_empty", "recent_data_availability"}
    rules = standard_rules()
    assert len(rules_at("quick", rules)) < len(rules_at("standard", rules))
    with pytest.raises(ValueError):
        rules_at("deep", rules)
    with pytest.raises(ValueError):
        runner.run_checks(t, AS_OF, only=["nope"])


def test_samples_are_bounded_and_smallest(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), F.format_string("%04d", "id").alias("s"))
    got = {r.g: r.samples for r in first_samples(df, ["g"], F.col("s"), 3).collect()}
    assert got == {True: ["0000", "0003", "0006"], False: ["0001", "0002", "0004"]}
    one = counted_issue(df, F.col("s"), severity="warning", category="accuracy", table="t", check="c",
                        description="d").first()
    assert (one["count"], one.samples) == (1000, ["0000", "0001", "0002", "0003", "0004"])
    assert counted_issue(df.filter("s = ''"), F.col("s"), severity="warning", category="accuracy", table="t",
                         check="c", description="d").count() == 0


def test_judge_rows_tolerates_up_to_allowed(clean):
    rule = [r for r in standard_rules({"max_invalid_ratios": 3}) if r.table == "indicator_data"]
    bad = clean["indicator_data"].withColumn("roe", F.lit(2.0))
    assert judge_rows(bad, rule).first()["count"] == 3
    looser = [r for r in standard_rules({"max_invalid_ratios": 4}) if r.table == "indicator_data"]
    assert judge_rows(bad, looser).count() == 0


def test_day_coverage_checks(clean):
    px = clean["price_data"].filter("NOT (day = DATE '2024-01-10' AND code <> '600000.SH')")
    days = [dt.date(2024, 1, 9), dt.date(2024, 1, 10)]
    r = checks.price_day_coverage(clean["stock_list"], px, days).collect()
    assert [(x.severity, x["count"], x.samples) for x in r] == [("critical", 2, ["000001.SZ", "430001.BJ"])]
    assert checks.price_day_sampled(clean["stock_list"], px, days, 3).first()["count"] == 2
    val = clean["valuation_data"].filter("NOT (day = DATE '2024-01-09' AND code = '000001.SZ')")
    r = checks.daily_alignment(clean["price_data"], val, "valuation_data", days=days).collect()
    assert [(x.severity, x["count"], x.samples) for x in r] == [("warning", 1, ["000001.SZ"])]


def test_report_coverage_and_freshness(clean):
    ind = clean["indicator_data"]
    day = [dt.date(2024, 2, 1)]
    assert checks.report_coverage(clean["stock_list"], ind, day).count() == 0
    r = checks.report_coverage(clean["stock_list"], ind.limit(1), day).first()
    assert (r.severity, r["count"]) == ("critical", 2)
    assert checks.report_coverage(clean["stock_list"], ind.limit(1), day, sample_size=3).first()["count"] == 2
    got = {r.check_name: r["count"] for r in checks.quarterly_freshness(ind, "2024-02-01", "2023-01-01", 3).collect()}
    assert got == {"quarters_missing": 3, "quarter_thin": 2}
    old = {r.check_name for r in checks.quarterly_freshness(ind, "2024-12-31", "2023-01-01", 1).collect()}
    assert "quarter_stale" in old and "quarters_missing" in old


def test_routine_on_clean_tables(clean):
    got = {(r.table_name, r.check_name) for r in runner.routine(
        clean, AS_OF, thresholds={**LOW, "min_quarter_rows": 2}).collect()}
    assert got == {("indicator_data", "quarters_missing")}


def test_reports(clean, spark):
    t = dict(clean)
    t["user_transactions"] = clean["user_transactions"].withColumn("trade_type", F.lit(1)).withColumn("amount", F.lit(1.0))
    issues = runner.run_checks(t, AS_OF, only=["user_transactions"], thresholds=LOW)
    assert tuple(report.totals(issues).first()) == (2, 1, 1, 1)
    assert rows(report.by_table(issues)) == [("user_transactions", 1, 1, 0)]
    assert rows(report.by_category(issues)) == [("accuracy", 2)]
    assert [r.severity for r in report.top_issues(issues).collect()] == ["critical", "warning"]
    path = shared_dir(spark, "report")
    report.write_report(issues, path, "quick", AS_OF)
    assert spark.read.json(f"{path}/summary").first().total_issues == 2
    assert "samples" in json.loads(report.json_rows(issues).first().value)


RULES = {"global_config": {"check_levels": {"quick": {"sample_size": 10}}, "thresholds": {"limit": 3}},
         "tables": {"stock_list": {"enabled": True, "uniqueness_checks": [
             {"name": "low", "sql": "SELECT COUNT(*) AS n FROM stock_list", "condition": "n < {limit}"},
             {"name": "le", "sql": "SELECT COUNT(*) AS n FROM stock_list", "condition": "n <= 3"},
             {"name": "ne", "sql": "SELECT COUNT(*) AS n FROM stock_list", "condition": "n != 3"},
             {"name": "eq", "sql": "SELECT COUNT(*) AS n FROM stock_list", "condition": "n = 3"},
             {"name": "none", "sql": "SELECT 1 AS n WHERE false", "condition": "n = 3"}]},
             "price_data": {"enabled": True, "completeness_checks": [
                 {"name": "time_series_completeness", "check_type": "time_series", "severity": "critical"},
                 {"name": "share", "sql": "SELECT COUNT(*) AS n FROM price_data",
                  "condition_template": "n >= {active_stocks} * 40"}]},
             "user_positions": {"enabled": False, "accuracy_checks": [{"name": "x", "sql": "SELECT 1"}]}}}


def test_rule_file(clean, spark):
    t = {**clean, "price_data": clean["price_data"].filter("day <> DATE '2024-01-15' AND day > DATE '2024-01-03'"
                                                          " OR code LIKE '%.SH'")}
    path = shared_dir(spark, "rules")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/rules.json", "w") as f:
        json.dump(RULES, f)
    issues = sql_rules.run_rule_file(sql_rules.load_rule_file(f"{path}/rules.json"), t, AS_OF)
    got = {r.check_name: (r.severity, r["count"]) for r in issues.collect()}
    assert got == {"low": ("warning", 3), "ne": ("warning", 3), "time_series_completeness": ("critical", 2),
                   "share": ("warning", 31 + 27 * 2)}
    with pytest.raises(ValueError):
        sql_rules.run_rule_file(RULES, t, AS_OF, tables=["nope"])


def test_volatile_moves_are_allowed_up_to_the_limit(clean):
    day = F.dayofmonth("day")
    t = {**clean, "price_data": clean["price_data"].withColumn(
        "close", F.when(day.isin(20) & F.col("code").endswith("SZ"), 20.0).otherwise(F.col("close")))}
    key = ("price_data", "abnormal_volatility")
    assert key in found(t)
    issues = runner.run_checks(t, AS_OF, thresholds={**LOW, "max_volatile_moves": 100})
    assert key not in {(r.table_name, r.check_name) for r in issues.collect()}


def test_one_failing_rule_leaves_the_others(clean):
    rules = {"tables": {"price_data": {"enabled": True, "accuracy_checks": [
        {"name": "zero", "severity": "warning", "sql": "SELECT 1 / (volume - volume) AS x FROM price_data"},
        {"name": "typo", "severity": "warning", "sql": "SELEC 1"},
        {"name": "many", "severity": "warning", "sql": "SELECT code FROM price_data WHERE close > 1"}],
        "completeness_checks": [{"name": "nulls", "severity": "warning", "fields": ["open", "note"],
                                 "sql_template": "SELECT code, {field} FROM price_data WHERE {field} IS NULL"}]}}}
    t = {**clean, "price_data": clean["price_data"].withColumn("note", F.when(F.col("code").endswith("SZ"), "x"))}
    got = {r.check_name: (r.severity, r["count"], r.description) for r in
           sql_rules.run_rule_file(rules, t, AS_OF).collect()}
    assert set(got) == {"zero", "typo", "many", "nulls_note"}
    assert got["zero"][0] == "critical" and "DIVIDE_BY_ZERO" in got["zero"][2]
    assert got["typo"][0] == "critical" and got["many"][1] == 93 and got["nulls_note"][1] == 62


def test_rule_file_in_yaml(clean, spark):
    yaml = pytest.importorskip("yaml")
    rules = {"tables": {"price_data": {"enabled": True, "accuracy_checks": [
        {"name": "many", "severity": "warning", "sql": "SELECT code FROM price_data WHERE close > 1"}]}}}
    path = f"{shared_dir(spark, 'yaml')}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/rules.yaml", "w", encoding="utf-8") as f:
        yaml.safe_dump(rules, f)
    got = sql_rules.run_rule_file(sql_rules.load_rule_file(f"{path}/rules.yaml"), clean, AS_OF).collect()
    assert [(r.check_name, r["count"]) for r in got] == [("many", 93)]
