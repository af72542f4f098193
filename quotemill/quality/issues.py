"""The shape every check returns, and bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.schemas import ISSUES

SAMPLES = 5


def text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def as_issues(df: DataFrame, *, severity: Column | str, category: str, table: Column | str,
              check: Column | str, description: Column | str, count: Column | None = None,
              samples: Column | None = None) -> DataFrame:
    """One issue per row of ``df``."""
    return df.select(
        text(severity).alias("severity"), F.lit(category).alias("category"),
        text(table).alias("table_name"), text(check).alias("check_name"),
        text(description).alias("description"),
        (F.lit(1) if count is None else count).cast("bigint").alias("count"),
        (F.array().cast("array<string>") if samples is None else samples).alias("samples"))


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUES)


def union_issues(parts: Iterable[DataFrame], spark: SparkSession) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return no_issues(spark) if out is None else out


def sample_text(columns: Sequence[str]) -> Column:
    """``(a, b, c)`` as the sample of a row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def first_samples(df: DataFrame, group: Sequence[str], sample: Column, n: int = SAMPLES) -> DataFrame:
    """The ``n`` smallest samples of each group as an array.

    The rank cut runs before the shuffle as well, so a group of any size sends at most
    ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy("_s")
    top = df.select(*group, sample.alias("_s")).withColumn("_n", F.row_number().over(w)) \
        .filter(F.col("_n") <= n)
    return top.groupBy(*group).agg(F.array_sort(F.collect_list("_s")).alias("samples"))


def top_samples(df: DataFrame, sample: Column, n: int = SAMPLES) -> Column:
    """The ``n`` smallest samples over everything, as a scalar subquery."""
    top = df.select(sample.alias("_s")).orderBy("_s").limit(n)
    return top.agg(F.array_sort(F.collect_list("_s")).alias("samples")).scalar()


def counted_issue(bad: DataFrame, sample: Column, *, n: int = SAMPLES, least: int = 1, **labels) -> DataFrame:
    """One issue when ``bad`` has at least ``least`` rows: their number and some samples."""
    counted = bad.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return as_issues(counted, count=F.col("n"), samples=top_samples(bad, sample, n), **labels)
