"""Stored tables: reading, views, ad-hoc SQL, catalog figures, snapshots and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.schemas import KEYS, PARTITION_YEAR, SCHEMAS, WATERMARK


def read_table(spark: SparkSession, base: str, table: str, merge_schema: bool = False) -> DataFrame:
    """A stored table. Its declared schema is used unless columns were added over time."""
    path = f"{base.rstrip('/')}/{table}"
    if merge_schema or table not in SCHEMAS:
        return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def register(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str, params: Sequence | Mapping | None = None) -> DataFrame:
    """Ad-hoc SQL over the registered views. Values are bound, never pasted into the text."""
    if params is None:
        return spark.sql(text)
    return spark.sql(text, args=dict(params) if isinstance(params, Mapping) else list(params))


def columns_of(df: DataFrame, table: str | None = None) -> DataFrame:
    """``name, type, not_null, primary_key`` of a table."""
    keys = KEYS.get(table or "", [])
    rows = [(f.name, f.dataType.simpleString(), not f.nullable or f.name in keys, f.name in keys)
            for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, not_null boolean, primary_key boolean")


def snapshot(df: DataFrame, base: str, table: str, stamp: str) -> str:
    """Copies a table to ``<base>/<table>_backup_<stamp>``; an existing copy is never replaced."""
    path = f"{base.rstrip('/')}/{table}_backup_{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_table(df: DataFrame, base: str, table: str) -> str:
    """Writes a whole table sorted by key inside the files, by year where it is dated.

    The year is that of the table's WATERMARK date, so only give that date to range reads that
    should skip folders. Rebalancing lets AQE split a year that holds much of the data.
    """
    path = f"{base.rstrip('/')}/{table}"
    keys = [k for k in KEYS.get(table, []) if k in df.columns]
    if table in WATERMARK:
        out = df.withColumn(PARTITION_YEAR, F.year(WATERMARK[table])).hint("rebalance", PARTITION_YEAR)
        out.sortWithinPartitions(PARTITION_YEAR, *keys).write.mode("overwrite") \
            .partitionBy(PARTITION_YEAR).parquet(path)
    else:
        df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN as NULL, so that records are valid JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def export_json(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def records(df: DataFrame) -> DataFrame:
    """One JSON text per row, NULL fields written."""
    ready = json_ready(df)
    return ready.select(F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"})
                        .alias("value"))
