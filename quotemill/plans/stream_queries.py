"""Streams over the driver's tables, worked off once and compared with the batch result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators import kept_states
from quotemill.plans.market import Market, code_from, dsum
from quotemill.plans.registry import query
from quotemill.session import shared_dir, stored
from quotemill.streaming import account_streams as st


def _dated(m: Market, lines):
    """Line items joined to the stored orders that date them."""
    orders = m.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("trade_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        code_from(F.col("l_suppkey")).alias("stock_code"), F.to_date("o_orderdate").alias("trade_date"),
        F.col("o_orderdate").alias("trade_time"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"))


def _trade_stream(m: Market):
    schema = m.raw("lineitem").schema
    return _dated(m, m.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(m.dir))


@query("stream_daily_trade_sums", "ledger", sql=f"""
    SELECT trade_date, user_id, stock_code, count(*) AS trade_count, {dsum('quantity')} AS total_quantity,
           {dsum('amount')} AS total_amount
    FROM ledger GROUP BY trade_date, user_id, stock_code""")
def stream_daily_trade_sums(m: Market):
    """Every day: the closed ones from the stream, those inside the watermark from the stored trades."""
    work = shared_dir(m.spark, "day-sums")
    sums = st.daily_trade_sums(_trade_stream(m))
    st.run(st.write_closed_days(sums, f"{work}/out", f"{work}/checkpoint"))
    closed = m.spark.read.schema(sums.schema).parquet(f"{work}/out")
    return st.with_open_days(closed, _dated(m, m.raw("lineitem")))


@query("stream_append_trades", "ledger", sql="""
    SELECT trade_id, min(trade_date) AS trade_date FROM ledger GROUP BY trade_id""")
def stream_append_trades(m: Market):
    work = shared_dir(m.spark, "trades")
    trades = _trade_stream(m).select("trade_id", "trade_date", "user_id", "quantity")
    st.run(st.append_trades(trades, f"{work}/table", f"{work}/checkpoint", partition_by=()))
    return m.spark.read.schema(trades.schema).parquet(f"{work}/table").select("trade_id", "trade_date")


def _lots(m: Market, rows: DataFrame, conditions: Sequence[Column], landed: str) -> Iterator[DataFrame]:
    """The rows land lot by lot, in as many files as they fill; each lot is a batch of the stream that follows it."""
    for hit in conditions:
        rows.filter(F.coalesce(hit, F.lit(False))).write.mode("append").parquet(landed)
        yield m.spark.readStream.schema(rows.schema).parquet(landed)


@query("stream_append_batches", "ledger", sql="""
    SELECT DISTINCT trade_id, CAST(year(trade_date) AS INTEGER) AS part_year FROM ledger""")
def stream_append_batches(m: Market):
    """Three batches, a quarter of the ids in each of them; only the folders of a batch's years are read."""
    work = shared_dir(m.spark, "batches")
    trades = stored(m.ledger.select("trade_id", "user_id", F.year("trade_date").alias("part_year")), "batches-in")
    part = F.crc32("trade_id") % 4
    for stream in _lots(m, trades, [part.isin(i, 3) for i in range(3)], f"{work}/landed"):
        st.run(st.append_trades(stream, f"{work}/table", f"{work}/checkpoint", partition_by=("part_year",),
                                keys=("trade_id", "part_year")))
    return m.spark.read.schema(trades.schema).parquet(f"{work}/table").select("trade_id", "part_year")


@query("stream_late_days", "ledger", sql=f"""
    SELECT trade_date, user_id, stock_code, count(*) AS trade_count, {dsum('quantity')} AS total_quantity,
           {dsum('amount')} AS total_amount
    FROM ledger GROUP BY trade_date, user_id, stock_code""")
def stream_late_days(m: Market):
    """Newest days first, then two lots of older ones and what has no day: what comes for days long written is merged into them."""
    work = shared_dir(m.spark, "late")
    trades = stored(m.ledger.select("trade_date", "user_id", "stock_code", "quantity", "amount",
                                    F.year("trade_date").alias("part_year")), "late-in")
    late = F.coalesce(F.crc32(F.col("trade_date").cast("string")) % 3, F.lit(0))
    newer = F.col("part_year") >= 1996
    kept = st.day_figures("part_year")
    lots = [newer, ~newer & (late == 1), ~newer & (late != 1), F.col("part_year").isNull()]
    for stream in _lots(m, trades, lots, f"{work}/landed"):
        st.run(st.keep_figures(stream, kept, f"{work}/states", f"{work}/checkpoint"))
    return kept_states.figures(m.spark.read.parquet(f"{work}/states"), kept).drop("_rows")


@query("stream_drop_repeats", "ledger", sql="SELECT trade_id, min(trade_date) AS trade_date FROM ledger GROUP BY trade_id")
def stream_drop_repeats(m: Market):
    """Every trade arrives twice; the state drops its repeat."""
    work = shared_dir(m.spark, "repeats")
    trades = m.ledger.select("trade_id", "trade_date", F.col("trade_date").alias("trade_time"))
    for _ in range(2):
        trades.write.mode("append").parquet(f"{work}/landed")
    stream = m.spark.readStream.schema(trades.schema).parquet(f"{work}/landed")
    once = st.drop_repeats(stream).select("trade_id", "trade_date")
    st.run(st.write_closed_days(once, f"{work}/out", f"{work}/checkpoint"))
    return m.spark.read.schema(once.schema).parquet(f"{work}/out")
