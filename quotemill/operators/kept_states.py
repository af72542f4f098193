"""Figures kept up to date beside a stored table: mergeable partial states per key and folder.

A state table holds, for every key and folder (a day, month or year) of a table, what its rows add to each
figure: counts, exact sums, smallest and largest values, the newest row. States of different rows merge, so
a load costs its own rows and the folders it touches, never the table, and rows that come late for a folder
long written are in the result like any other. A deletion reads the rows of the folders it touched again
(a maximum cannot be taken back) and no others.

A folder is replaced as a whole and remembers the number of the last load in it. Loads are numbered
upwards; one that runs again after a failure skips the folders it has reached, so nothing counts twice.

Cases: a NULL key is a key, a NULL folder a folder; repeated rows count each; an empty load changes nothing;
a folder that nothing is left of is removed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import merge
from quotemill.operators.ledger import signed
from quotemill.session import stored

LOAD = "_load"


@dataclass(frozen=True)
class Figures:
    """What is kept. Values are column names or expressions over the table's rows.

    ``counts``: rows whose value is not NULL. ``sums``: exact, ten decimals per row. ``least`` and
    ``greatest``: NULLs aside. ``newest``: name -> columns; the largest row by these columns in order.
    """

    keys: tuple[str, ...]
    folder: str
    counts: Mapping[str, str | Column] = field(default_factory=dict)
    sums: Mapping[str, str | Column] = field(default_factory=dict)
    least: Mapping[str, str | Column] = field(default_factory=dict)
    greatest: Mapping[str, str | Column] = field(default_factory=dict)
    newest: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def partial_states(rows: DataFrame, kept: Figures) -> DataFrame:
    """One row per folder and key of ``rows``."""
    return rows.groupBy(*dict.fromkeys([kept.folder, *kept.keys])).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(_of(c)).alias(n) for n, c in kept.counts.items()],
        *[F.sum(_of(c).cast("decimal(38,10)")).alias(n) for n, c in kept.sums.items()],
        *[F.min(_of(c)).alias(n) for n, c in kept.least.items()],
        *[F.max(_of(c)).alias(n) for n, c in kept.greatest.items()],
        *[F.max(F.struct(*columns)).alias(n) for n, columns in kept.newest.items()])


def merged_states(states: DataFrame, kept: Figures, by: Sequence[str]) -> DataFrame:
    """States of the same ``by`` columns as one."""
    added = ["_rows", *kept.counts, *kept.sums]
    return states.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in added], *[F.min(n).alias(n) for n in kept.least],
        *[F.max(n).alias(n) for n in [*kept.greatest, *kept.newest]])


def _held(spark: SparkSession, path: str, schema) -> DataFrame:
    """The states so far, none before the first load."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _named(rows: DataFrame, kept: Figures) -> DataFrame:
    """Sums and counts as they are stored: types do not depend on how often states were merged."""
    return rows.select(*[F.col(n).cast("decimal(38,10)").alias(n) if n in kept.sums else
                         F.col(n).cast("long").alias(n) if n == "_rows" or n in kept.counts else F.col(n)
                         for n in rows.columns])


def add_load(path: str, batch: DataFrame, kept: Figures, load: int) -> list:
    """Merges the rows of a numbered load into the folders they belong to. Returns the folders written.

    Reads and writes the touched folders' states only. Which folders these are is fetched, one value each.
    """
    spark = batch.sparkSession
    fresh = stored(_named(partial_states(batch, kept), kept).withColumn(LOAD, F.lit(load).cast("long")), "states")
    values = merge.partition_values(fresh, kept.folder)
    held = merge.folder_rows(_held(spark, path, fresh.schema), kept.folder, values)
    reached = {r[0] for r in held.groupBy(kept.folder).agg(F.max(LOAD).alias("_last"))
               .where(F.col("_last") >= load).select(kept.folder).collect()}
    values = sorted((v for v in values if v not in reached), key=lambda v: (v is None, str(v)))
    if values:
        both = merge.folder_rows(held.unionByName(fresh), kept.folder, values)
        by = list(dict.fromkeys([kept.folder, *kept.keys]))
        now = _named(merged_states(both, kept, by), kept).withColumn(LOAD, F.lit(load).cast("long"))
        merge.replace_folders(spark, path, kept.folder, values, now.select(*fresh.columns))
    return values


def refold(path: str, table: DataFrame, kept: Figures, values: Sequence) -> None:
    """Takes the states of the named folders from the table again; run it for the folders a deletion touched.

    It may run as often as needed. The folders keep the number of their last load.
    """
    if not values:
        return
    spark = table.sparkSession
    anew = _named(partial_states(merge.folder_rows(table, kept.folder, values), kept), kept)
    held = merge.folder_rows(_held(spark, path, anew.withColumn(LOAD, F.lit(0).cast("long")).schema), kept.folder, values)
    last = F.broadcast(held.groupBy(F.col(kept.folder).alias("_f")).agg(F.max(LOAD).alias(LOAD)))  # one row a folder
    numbered = anew.join(last, F.col(kept.folder).eqNullSafe(F.col("_f")), "left").drop("_f")
    merge.replace_folders(spark, path, kept.folder, values, numbered.withColumn(LOAD, F.coalesce(LOAD, F.lit(0).cast("long"))))


def delete_rows(table_path: str, path: str, spark: SparkSession, kept: Figures, **equals) -> list:
    """Deletes rows of the stored table (in folders of the same column) and brings the states in line."""
    values = merge.delete_stored(spark, table_path, kept.folder, **equals)
    refold(path, spark.read.parquet(table_path), kept, values)
    return values


def figures(states: DataFrame, kept: Figures, scale: int = 4) -> DataFrame:
    """The figures per key over all folders; sums as doubles with ``scale`` decimals."""
    whole = merged_states(states, kept, kept.keys)
    return whole.select(*kept.keys, "_rows", *[F.col(n).cast("long").alias(n) for n in kept.counts],
                        *[F.col(n).cast(f"decimal(38,{scale})").cast("double").alias(n) for n in kept.sums],
                        *kept.least, *kept.greatest, *kept.newest)


def position_figures(folder: str) -> Figures:
    """What to keep over loads of a ledger for ``net_positions``."""
    return Figures(keys=("user_id", "stock_code"), folder=folder,
                   sums={"total_quantity": signed("quantity"), "total_amount": signed("net_amount")})


def net_positions(states: DataFrame, kept: Figures) -> DataFrame:
    """``ledger.net_positions`` over all dates, from kept states instead of the ledger."""
    return figures(states, kept).filter("total_quantity > 0").select(
        "user_id", "stock_code", "total_quantity", "total_amount", F.col("_rows").alias("transaction_count"))
