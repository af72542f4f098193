"""Rule files written by users: SQL texts with a condition, a field list, or nothing.

A rule file holds ``global_config`` (levels, thresholds) and ``tables`` with lists of
``completeness_checks``, ``uniqueness_checks`` and ``accuracy_checks``. Each rule's SQL runs
on temp views of the tables; Spark judges the condition, so nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.quality.checks import series_completeness
from quotemill.quality.issues import as_issues, sample_text, top_samples, union_issues
from quotemill.schemas import ISSUES, WATERMARK

CATEGORIES = ("completeness", "uniqueness", "accuracy")
DATE_COLUMN_FOR_RECENT = {**WATERMARK, "indicator_data": "statDate"}


def load_rule_file(path: str) -> dict:
    """A JSON rule file, or a YAML one where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML rules needs the yaml package; use JSON") from e
    return yaml.safe_load(text)


def fill(text: str, context: Mapping) -> str:
    """Replaces ``{name}`` for the names in ``context``; other braces stay."""
    return re.sub(r"\{(\w+)\}",
                  lambda m: str(context[m[1]]) if m[1] in context else m[0], text)


def _labels(rule: Mapping, table: str, category: str, suffix: str = "", note: str = "") -> dict:
    name = rule["name"] + suffix
    return {"severity": rule.get("severity", "warning"), "category": category, "table": table,
            "check": name, "description": rule.get("description", f"{name} failed") + note}


def _context_values(table: str, views: Mapping[str, DataFrame], as_of: str) -> dict[str, Column]:
    """Scalars: active securities, rows of the table, its rows of the last 30 days."""
    df = views[table]
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    date_col = DATE_COLUMN_FOR_RECENT.get(table)
    if date_col in df.columns:
        recent = df.filter(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), 30)).agg(
            F.count(F.lit(1)).alias("n")).scalar()
    else:
        recent = total
    active = F.lit(0)
    if "stock_list" in views:
        from quotemill.operators.coverage import active_count

        active = active_count(views["stock_list"], as_of).scalar()
    return {"active_stocks": active, "total_records": total, "recent_records": recent}


def _condition_issue(result: DataFrame, condition: str, rule: Mapping, table: str, category: str,
                     context: Mapping[str, Column] | None = None) -> DataFrame:
    """Issue when the first row does not meet ``field op number`` (or an expression of fields)."""
    m = re.match(r"\s*(\w+)\s*(<=|>=|!=|<>|==|=|<|>)\s*(.+)$", condition.strip())
    if not m:
        raise ValueError(f"rule {rule['name']}: cannot read condition {condition!r}")
    field, op, bound = m[1], m[2].replace("==", "="), m[3]
    first = result.limit(1)
    if context is not None:
        first = first.withColumns({k: v for k, v in context.items() if k in bound})
    failed = first.filter(F.coalesce(~F.expr(f"{field} {op} ({bound})"), F.lit(True)))
    return as_issues(failed, count=F.coalesce(F.col(field).cast("bigint"), F.lit(0)),
                     **_labels(rule, table, category))


def _rows_issue(result: DataFrame, rule: Mapping, table: str, category: str) -> DataFrame:
    """Issue when the SQL returns rows: how many, and five of them."""
    shown = [c for c in result.columns if c != "count"]
    counted = result.agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 0)
    return as_issues(counted, count=F.col("_rows"), samples=top_samples(result, sample_text(shown)),
                     **_labels(rule, table, category))


def _field_issues(spark: SparkSession, rule: Mapping, table: str, category: str,
                  context: Mapping) -> list[DataFrame]:
    """One SQL per field. A ``null_count`` column is the figure, otherwise rows are counted."""
    out = []
    for field in rule.get("fields", []):
        result = spark.sql(fill(rule["sql_template"], {**context, "field": field}))
        if "null_count" in result.columns:
            figure = result.select(F.col("null_count").cast("bigint").alias("n"))
        else:
            figure = result.agg(F.count(F.lit(1)).alias("n"))
        bad = figure.filter(F.col("n") > rule.get("threshold", 0))
        out.append(as_issues(bad, count=F.col("n"),
                             **_labels(rule, table, category, f"_{field}", f" - {field}")))
    return out


def _one_rule(spark, rule, table, category, views, context, as_of, seed) -> list[DataFrame]:
    if "sql" in rule:
        result = spark.sql(fill(rule["sql"], context))
        if "condition" in rule:
            return [_condition_issue(result, fill(rule["condition"], context), rule, table, category)]
        if "condition_template" in rule:
            plain = re.sub(r"\{(\w+)\}", r"\1", fill(rule["condition_template"], context))
            return [_condition_issue(result, plain, rule, table, category,
                                     _context_values(table, views, as_of))]
        return [_rows_issue(result, rule, table, category)]
    if "sql_template" in rule:
        return _field_issues(spark, rule, table, category, context)
    if rule.get("check_type") == "time_series" or rule["name"] == "time_series_completeness":
        prices = views[table]
        issue = series_completeness(
            views["stock_list"], prices, None, as_of,
            context["sample_size"], float(rule.get("completion_threshold", 0.95)), seed)
        return [issue.withColumn("severity", F.lit(rule.get("severity", "warning")))]
    raise ValueError(f"rule {rule['name']} has neither sql, sql_template nor check_type")


def _first_cause(e: PySparkException | Py4JJavaError) -> str:
    """The first line of what went wrong; a failure inside a subquery comes wrapped."""
    text = str(e)
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        text = cause.getMessage() or cause.toString()
    return text.splitlines()[0][:200]


def run_rule_file(rules: Mapping, views: Mapping[str, DataFrame], as_of: str, level: str = "quick",
                  tables: Sequence[str] | None = None, seed: str = "0") -> DataFrame:
    """Issues of a rule file over the given tables.

    Every rule is evaluated by itself, so one that fails, when read or when run, is one issue and the
    others go on. What is fetched is the issues: at most one per rule and listed field.
    """
    spark = next(iter(views.values())).sparkSession
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    config = rules.get("global_config", {})
    levels = config.get("check_levels", {})
    context = {**config.get("thresholds", {}), "as_of": as_of,
               "sample_size": levels.get(level, {}).get("sample_size")}
    listed = rules["tables"]
    unknown = [t for t in (tables or []) if t not in listed]
    if unknown:
        raise ValueError(f"rule file has no table {unknown}")
    chosen = tables or levels.get(level, {}).get("default_tables") or list(listed)
    issues = []
    for table in chosen:
        spec = listed[table]
        if not spec.get("enabled", False) or table not in views:
            continue
        for category in CATEGORIES:
            for rule in spec.get(f"{category}_checks", []):
                if rule.get("level", "quick") != "quick" and level == "quick":
                    continue
                try:
                    found = union_issues(_one_rule(spark, rule, table, category, views,
                                                   {**context, "table_name": table}, as_of, seed), spark)
                    issues += [tuple(r) for r in found.collect()]
                except (PySparkException, Py4JJavaError) as e:
                    note = _first_cause(e)
                    issues.append(("critical", category, table, rule["name"], f"rule SQL failed: {note}", 0, []))
    return spark.createDataFrame(issues, ISSUES)
