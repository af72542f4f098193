"""Account files as streams: trades appended once, snapshots replaced, trades summed by day.

Targets are Parquet tables on shared storage. Each micro-batch is judged against the table
itself, so a batch that runs again after a failure changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from quotemill.functions.values import money_sum
from quotemill.operators import kept_states, merge
from quotemill.schemas import SCHEMAS
from quotemill.session import discard, shared_dir, stored
from quotemill.sources import account_files as af


def trade_file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New trade files as rows of ``user_transactions``; refused files give no rows."""
    return af.trades_from(af.read_files(spark.readStream, path, af.TRADE_FILE, "trades")).drop("file_path")


def position_file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New position files, one row per file with its holdings still nested."""
    return af.read_files(spark.readStream, path, af.POSITION_FILE, "positions")


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table so far; an empty one before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _touched(held: DataFrame, batch: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
    """Rows of the folders a batch writes to. Their values go into the scan as literals, one per folder."""
    first = partition_by[0]
    values = [v for v in merge.partition_values(batch, first) if v is not None]
    return merge.touched_partitions(held.filter(F.col(first).isin(values)), batch, partition_by)


def append_trades(stream: DataFrame, table_path: str, checkpoint: str,
                  partition_by: tuple[str, ...] = ("trade_date",),
                  keys: tuple[str, ...] = ("trade_id",)) -> DataStreamWriter:
    """Appends trades whose key the table lacks.

    With the id alone as key a repeat is found whatever its date, at the price of reading all ids of
    the table for every batch. Where ids repeat only within a date, give ``("trade_id", "trade_date")``:
    then only the date folders a batch touches are listed in the scan, however long the table grows.
    """

    def add(batch: DataFrame, _epoch: int) -> None:
        held = _existing(batch.sparkSession, table_path, stream.schema)
        if partition_by and set(partition_by) <= set(keys):
            held = _touched(held, batch, partition_by)
        fresh = merge.insert_new(held, batch, list(keys))
        merge.append(fresh.hint("rebalance", *partition_by), table_path, partition_by)

    return _available(stream.writeStream.foreachBatch(add), checkpoint)


def drop_repeats(stream: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Drops repeated trade ids that arrive within a horizon, with state bounded by it.

    Spares the table lookups for near repeats; ``append_trades`` catches the rest. Rows later
    than the horizon are lost here, so use it only where files arrive in date order.
    """
    timed = stream.withColumn("_event", F.col("trade_time").cast("timestamp"))
    return timed.withWatermark("_event", horizon).dropDuplicatesWithinWatermark(["trade_id"]) \
        .drop("_event")


_FILE_LOG = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("position_date", T.DateType()),
    T.StructField("modified", T.TimestampType()), T.StructField("file_path", T.StringType())])


def _drop_emptied_days(table_path: str, pairs: DataFrame, days: list, schema: T.StructType, filled: DataFrame) -> None:
    """Folders of the batch's dates ``days`` in which only holdings of emptied pairs are left.

    A write replaces only folders it has rows for, so a date that became empty must go by itself. ``filled`` has the
    ``position_date`` of the files with holdings.
    """
    spark = pairs.sparkSession
    held = merge.folder_rows(_existing(spark, table_path, schema), "position_date", days)
    others = held.join(pairs, ["user_id", "position_date"], "left_anti").select("position_date")
    left = set(merge.partition_values(others.unionByName(filled), "position_date"))
    for day in days:
        if day not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/position_date={day}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_snapshots(stream: DataFrame, table_path: str, checkpoint: str) -> DataStreamWriter:
    """Holdings of the newest file per account and day replace what the table has for them.

    The account and day pairs of a batch decide which date partitions are written again. Which file
    each pair was last taken from is kept beside the table (``<table_path>_files``), so an older file
    that arrives in a later batch changes nothing. A file without holdings empties its pair; a date that
    nothing is left of loses its folder. The log is written last: a batch that fails before that runs
    again with the same result.

    The dates of a batch are fetched and name the folders to read, so the table is not shuffled to find them; the parsed
    files go when their batch is done.
    """
    schema = SCHEMAS["user_positions"]
    log_path = f"{table_path.rstrip('/')}_files"

    def put(batch: DataFrame, _epoch: int) -> None:
        # Parsed once and stored: a batch has its own session without adaptive execution, so all else runs in the caller's.
        spark = stream.sparkSession
        path = f"{shared_dir(spark, 'batch-files')}/rows"
        batch.filter(F.col("reject_reason").isNull()).write.option("compression", "zstd").parquet(path)
        good = spark.read.schema(batch.schema).parquet(path)
        newest = good.groupBy("user_id", F.col("file_date").alias("position_date")).agg(
            F.max(F.struct("modified", "file_path")).alias("_new"))
        named = merge.partition_values(newest, "position_date")
        seen = merge.folder_rows(_existing(spark, log_path, _FILE_LOG), "position_date", named) \
            .groupBy("user_id", "position_date").agg(F.max(F.struct("modified", "file_path")).alias("_old"))
        taken = stored(newest.join(seen, ["user_id", "position_date"], "left")
                       .filter(F.col("_old").isNull() | (F.col("_new") >= F.col("_old")))
                       .select("user_id", "position_date", "_new.modified", "_new.file_path"), "batch-taken")
        files = good.join(taken.select("file_path", "modified"), ["file_path", "modified"], "left_semi")
        rows = af.positions_from(files).drop("file_path").select(*schema.fieldNames())
        days = merge.partition_values(taken, "position_date")
        held = merge.folder_rows(_existing(spark, table_path, schema), "position_date", days)
        kept = held.join(taken, ["user_id", "position_date"], "left_anti")
        merge.write_partitions(
            kept.select(*schema.fieldNames()).unionByName(rows), table_path, ["position_date"])
        filled = files.filter(F.size("positions") > 0).select(F.col("file_date").alias("position_date"))
        _drop_emptied_days(table_path, taken.select("user_id", "position_date").distinct(), days, schema, filled)
        merge.append(taken, log_path, ("position_date",))
        discard(spark, path)

    return _available(stream.writeStream.foreachBatch(put), checkpoint)


def daily_trade_sums(stream: DataFrame, delay: str = "7 days", time_col: str = "trade_time") -> DataFrame:
    """Trades per day, user and stock; a day comes out once the watermark has passed it.

    Rows later than that are not in it; ``keep_figures`` takes them in.

    Windows start at midnight UTC, so the session time zone should be UTC.
    """
    timed = stream.withColumn("_event", F.col(time_col).cast("timestamp"))
    return (timed.withWatermark("_event", delay)
            .groupBy(F.window("_event", "1 day").alias("w"), "user_id", "stock_code")
            .agg(F.count(F.lit(1)).alias("trade_count"), money_sum("quantity").alias("total_quantity"),
                 money_sum("amount").alias("total_amount"))
            .select(F.to_date("w.start").alias("trade_date"), "user_id", "stock_code", "trade_count",
                    "total_quantity", "total_amount"))


def day_figures(partition_by: str = "trade_date") -> kept_states.Figures:
    """Trades, quantity and amount per day, user and stock, kept in folders by ``partition_by``."""
    return kept_states.Figures(keys=("trade_date", "user_id", "stock_code"), folder=partition_by,
                               counts={"trade_count": F.lit(1)},
                               sums={"total_quantity": "quantity", "total_amount": "amount"})


def keep_figures(stream: DataFrame, kept: kept_states.Figures, state_path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps figures over all rows that came, late ones included, however old their day is.

    No watermark and no streaming state: every batch is merged into the folders it touches, and is a numbered
    load, so one that runs again counts once. A state table belongs to one checkpoint: with a new
    checkpoint numbers start anew, so start a new table too.
    """
    def add(batch: DataFrame, epoch: int) -> None:
        kept_states.add_load(state_path, batch, kept, epoch + 1)

    return _available(stream.writeStream.foreachBatch(add), checkpoint)


def with_open_days(closed: DataFrame, trades: DataFrame, time_col: str = "trade_time") -> DataFrame:
    """The days the stream has closed, and from the stored trades those it still holds open."""
    done = closed.select(F.col("trade_date").alias("_day")).distinct()
    newer = trades.withColumn("_day", F.to_date(F.col(time_col).cast("timestamp"))).join(
        done, "_day", "left_anti").drop("_day")
    return closed.unionByName(daily_trade_sums(newer, time_col=time_col))


def write_closed_days(sums: DataFrame, out_path: str, checkpoint: str) -> DataStreamWriter:
    return _available(sums.writeStream.outputMode("append").format("parquet").option("path", out_path),
                      checkpoint)


def _available(writer: DataStreamWriter, checkpoint: str) -> DataStreamWriter:
    """Works off what is there and stops; run it again for what came since."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run(writer: DataStreamWriter) -> None:
    q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
