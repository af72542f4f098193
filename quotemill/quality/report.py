"""Summaries of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.count_if(F.col("severity") == "warning").alias("warning_issues"),
        F.count_distinct("table_name").alias("tables_with_issues"))


def by_table(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table_name").pivot("severity", ["critical", "warning", "info"]).agg(
        F.count(F.lit(1))).na.fill(0)


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top_issues(issues: DataFrame, critical: int = 2, warning: int = 1) -> DataFrame:
    """The largest critical issues, then the largest warnings."""
    rank = F.row_number().over(Window.partitionBy("severity").orderBy(
        F.col("count").desc(), "table_name", "check_name"))
    keep = ((F.col("severity") == "critical") & (F.col("_n") <= critical)) | (
        (F.col("severity") == "warning") & (F.col("_n") <= warning))
    widest = max(critical, warning)
    return issues.withColumn("_n", rank).filter(F.col("_n") <= widest).filter(keep) \
        .orderBy("severity", "_n").drop("_n")


def json_rows(issues: DataFrame) -> DataFrame:
    """One JSON text per issue; nulls are written."""
    return issues.select(F.to_json(F.struct(*issues.columns), {"ignoreNullFields": "false"})
                         .alias("value"))


def write_report(issues: DataFrame, path: str, level: str, as_of: str) -> None:
    """Issues under ``path/issues`` and the totals under ``path/summary``, as JSON."""
    issues.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/issues")
    done = issues.sparkSession.read.schema(issues.schema).json(f"{path}/issues")
    totals(done).select(F.lit(level).alias("check_level"), F.lit(as_of).alias("as_of"), "*") \
        .write.mode("overwrite").json(f"{path}/summary")
