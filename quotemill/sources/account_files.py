"""Trade and position files that brokers' terminals drop, one JSON per account and day.

``.../account/<digits>/trades_orders/YYYYMMDD.json`` and
``.../account/<digits>/account_positions/YYYYMMDD.json``.

Files are read loose (a path or glob) or from a *bundle*: a Parquet folder named ``<name>.bundle`` that holds one
landed file per row, in the columns of Spark's ``binaryFile`` source. A year of a million accounts is a listing of
hundreds of millions of loose files, a block of disk and an open each; as rows of a bundle they cost their bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import trades as tf
from quotemill.functions.dates import from_compact, trade_timestamp
from quotemill.operators.ledger import (
    account_is_valid,
    position_is_valid,
    trade_is_valid,
    with_marks,
)

# --- fixed values: field names of the files ---------------------------------
# Alternate names of one trade field, first one that is there counts.
TRADE_FIELDS = {
    "code": ["Code", "证券代码", "StockCode"],
    "quantity": ["Volume", "Quantity", "成交数量"],
    "price": ["Price", "TradePrice", "成交均价"],
    "amount": ["Value", "Amount", "成交金额"],
    "net_amount": ["NetAmount", "成交金额"],
    "order_id": ["OrderID", "OrderId", "订单编号"],
}
POSITION_ITEM = (
    "`证券代码` STRING, `持仓数量` INT, `可用数量` INT, `冻结数量` INT, `在途股份` INT, "
    "`昨夜持股` INT, `开仓价格` DOUBLE, `持仓市值` DOUBLE"
)
ACCOUNT_ITEM = "`总资产` DOUBLE, `持仓市值` DOUBLE, `可用资金` DOUBLE, `冻结资金` DOUBLE"
# --- end of fixed values ----------------------------------------------------

BAD = "_corrupt"


def _struct(columns: str) -> str:
    return "STRUCT<" + ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", ")) + ">"


# A map per trade: some field names differ only in case, which columns could not.
TRADE_FILE = f"trades ARRAY<MAP<STRING, STRING>>, {BAD} STRING"
POSITION_FILE = (f"timestamp STRING, account_info {_struct(ACCOUNT_ITEM)}, "
                 f"positions ARRAY<{_struct(POSITION_ITEM)}>, {BAD} STRING")


#: A landed file as a row, as ``binaryFile`` reads it.
BUNDLE_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def is_bundle(path: str) -> bool:
    return path.rstrip("/").endswith(".bundle")


def write_bundle(files: DataFrame, path: str) -> None:
    """Adds files (``path, modificationTime, length, content``) to a bundle."""
    if not is_bundle(path):
        raise ValueError("a bundle's name ends in .bundle")
    files.select("path", "modificationTime", "length", "content").write.mode("append").option(
        "compression", "zstd").parquet(path)


def bundle_files(spark: SparkSession, loose: str, path: str) -> None:
    """Packs loose files into a bundle; run it once for each lot that landed."""
    write_bundle(spark.read.format("binaryFile").load(loose), path)


def opened_bundle(files: DataFrame, schema: str) -> DataFrame:
    """Rows of a bundle parsed as the JSON reader parses loose files: ``file_path, modified`` and the file's fields.

    A file that is empty or a list of objects is refused (loose, an empty one gives no row and a list a row per object).
    """
    text = F.ltrim(F.col("content").cast("string"), F.lit("\ufeff"))
    parsed = files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"),
                          F.from_json(text, schema, {"columnNameOfCorruptRecord": BAD}).alias("_file"))
    return parsed.select("file_path", "modified", "_file.*")


def _file_columns(path: Column) -> dict[str, Column]:
    return {
        "user_id": F.nullif(F.regexp_extract(path, r"/account/([0-9]+)/", 1), F.lit("")),
        "file_date": from_compact(F.regexp_extract(path, r"/([0-9]{8})\.json$", 1)),
    }


def _reason(payload: str) -> Column:
    return (F.when(F.col("file_date").isNull(), "file name is not YYYYMMDD.json")
            .when(F.col("user_id").isNull(), "no account number in the path")
            .when(F.col(BAD).isNotNull(), "malformed JSON")
            .when(F.col(payload).isNull(), f"no {payload} list"))


def read_files(reader, path: str, schema: str, payload: str) -> DataFrame:
    """One row per file, loose or of a bundle, by a batch or stream reader; ``modified`` is its time stamp."""
    if is_bundle(path):
        files = opened_bundle(reader.schema(BUNDLE_FILE).parquet(path), schema)
    else:
        files = reader.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", BAD).json(path) \
            .withColumn("modified", F.col("_metadata.file_modification_time")) \
            .withColumn("file_path", F.col("_metadata.file_path"))
    return files.withColumns(_file_columns(F.col("file_path"))).withColumn("reject_reason", _reason(payload))


def trade_files(spark: SparkSession, path: str, users: Sequence[str] | None = None) -> DataFrame:
    """One row per file: path, account, date, its trades and why it is refused, if it is."""
    df = read_files(spark.read, path, TRADE_FILE, "trades")
    return df if users is None else df.filter(F.col("user_id").isin(list(users)))


def position_files(spark: SparkSession, path: str, users: Sequence[str] | None = None) -> DataFrame:
    df = read_files(spark.read, path, POSITION_FILE, "positions")
    return df if users is None else df.filter(F.col("user_id").isin(list(users)))


def rejected_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reject_reason").isNotNull()).select("file_path", "reject_reason")


def trades_from(files: DataFrame) -> DataFrame:
    """Trades of the accepted files in the shape of ``user_transactions``."""
    rows = files.filter(F.col("reject_reason").isNull()).select(
        "file_path", "user_id", "file_date", F.posexplode("trades").alias("_pos", "t"))

    def text(name: str) -> Column:
        names = TRADE_FIELDS.get(name, [name])
        return F.coalesce(*[F.try_element_at("t", F.lit(n)) for n in names])

    def number(name: str) -> Column:
        return F.coalesce(text(name).try_cast("double"), F.lit(0.0))

    code, time_text, remark = text("code"), text("TradeTime"), text("Remark")
    own_id = F.nullif(text("TradeId"), F.lit(""))
    return rows.select(
        F.coalesce(own_id, tf.generated_trade_id("user_id", "file_date", code, time_text,
                                                 number("price"), number("quantity"), "_pos"))
        .alias("trade_id"),
        "user_id", code.alias("stock_code"), F.col("file_date").alias("trade_date"),
        trade_timestamp("file_date", time_text).alias("trade_time"),
        F.coalesce(text("TradeType").try_cast("int"), F.lit(23)).alias("trade_type"),
        tf.strategy_from_prefix(remark).alias("strategy_id"),
        *[number(c).alias(c) for c in ("quantity", "price", "amount")],
        number("Commission").alias("commission"), number("Tax").alias("stamp_tax"),
        number("OtherFees").alias("other_fees"), number("net_amount").alias("net_amount"),
        F.coalesce(text("order_id"), F.lit("")).alias("order_id"), remark.alias("remark"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), "file_path")


def positions_from(files: DataFrame) -> DataFrame:
    """Holdings of the accepted files in the shape of ``user_positions``."""
    rows = files.filter(F.col("reject_reason").isNull()).select(
        "file_path", "user_id", "file_date", "timestamp", F.explode("positions").alias("p"))
    p = {c: F.col(f"p.`{c}`") for c in rows.schema["p"].dataType.fieldNames()}
    stamp = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    none = F.lit(None).cast("double")
    out = rows.select(
        tf.position_id("user_id", "file_date", p["证券代码"]).alias("position_id"), "user_id",
        F.col("file_date").alias("position_date"), p["证券代码"].alias("stock_code"),
        p["持仓数量"].alias("position_quantity"), p["可用数量"].alias("available_quantity"),
        F.coalesce(p["冻结数量"], F.lit(0)).alias("frozen_quantity"),
        F.coalesce(p["在途股份"], F.lit(0)).alias("transit_shares"),
        F.coalesce(p["昨夜持股"], F.lit(0)).alias("yesterday_quantity"),
        p["开仓价格"].alias("open_price"), p["持仓市值"].alias("market_value"),
        none.alias("current_price"), none.alias("unrealized_pnl"),
        none.alias("unrealized_pnl_ratio"), F.lit(None).cast("string").alias("remark"),
        stamp.alias("timestamp"), stamp.alias("created_at"), stamp.alias("updated_at"),
        "file_path")
    return with_marks(out)


def accounts_from(files: DataFrame) -> DataFrame:
    """Account rows of the accepted files in the shape of ``user_account_info``."""
    stamp = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    a = {c: F.col(f"account_info.`{c}`") for c in ("总资产", "持仓市值", "可用资金", "冻结资金")}
    none = F.lit(None).cast("double")
    return files.filter(F.col("reject_reason").isNull() & F.col("account_info").isNotNull()).select(
        "user_id", F.col("file_date").alias("info_date"), a["总资产"].alias("total_assets"),
        a["持仓市值"].alias("position_market_value"), a["可用资金"].alias("available_cash"),
        F.coalesce(a["冻结资金"], F.lit(0.0)).alias("frozen_cash"),
        none.alias("total_profit_loss"), none.alias("total_profit_loss_ratio"),
        stamp.alias("timestamp"), stamp.alias("created_at"), stamp.alias("updated_at"), "file_path")


def _per_file(files: DataFrame, rows: DataFrame, valid: Column) -> DataFrame:
    counts = rows.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_invalid"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_rows", "n_valid", "n_invalid")}
    return files.select("file_path", "user_id", "file_date", "reject_reason").join(
        counts, "file_path", "left").withColumns(zero)


def trade_file_report(files: DataFrame) -> DataFrame:
    """Per file: trades, valid and invalid ones, or why the file was refused."""
    return _per_file(files, trades_from(files), trade_is_valid())


def position_file_report(files: DataFrame) -> DataFrame:
    """Dry run over position files: holdings, valid ones, and whether an account row is there."""
    report = _per_file(files, positions_from(files), position_is_valid())
    accounts = accounts_from(files).select(
        "file_path", F.lit(True).alias("account_present"),
        account_is_valid().alias("account_valid"))
    return report.join(accounts, "file_path", "left").withColumns({
        c: F.coalesce(c, F.lit(False)) for c in ("account_present", "account_valid")})


def directory_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("n_rejected"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("n_valid"), F.lit(0)).cast("bigint").alias("n_valid"),
        F.count_distinct("user_id").alias("n_users"))
