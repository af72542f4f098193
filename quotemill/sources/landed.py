"""Landed vendor extracts brought to the shape of the market tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.codes import exchange_of, is_special_treatment, market_of, standard_code
from quotemill.functions.dates import day as as_day
from quotemill.functions.dates import drop_far_future, from_compact, parse_date
from quotemill.functions.values import blank_to_null, to_number
from quotemill.schemas import SCHEMAS

# --- fixed values: column renames of the feeds ------------------------------
FEED_RENAMES = {"vol": "volume", "amount": "money", "ts_code": "code"}
CAMEL_RENAMES = {"pubDate": "pub_date", "statDate": "stat_date"}
LEGACY_BALANCE_RENAMES = {
    "loan_and_advance_current": "loan_and_advance_current_assets",
    "held_to_maturity_investments": "hold_to_maturity_investments",
    "long_term_receivable": "longterm_receivable_account",
    "long_term_equity_invest": "longterm_equity_invest",
    "investment_real_estate": "investment_property",
    "oil_and_gas_assets": "oil_gas_assets",
    "short_term_loan": "shortterm_loan",
    "borrowing_from_central_bank": "borrowing_from_centralbank",
    "long_term_loan": "longterm_loan",
    "long_term_account_payable": "longterm_account_payable",
    "estimated_liability": "estimate_liability",
    "earned_surplus": "surplus_reserve_fund",
    "general_risk_preparation": "ordinary_risk_reserve_fund",
    "undistributed_profit": "retained_profit",
    "foreign_exchange_gain": "foreign_currency_report_conv_diff",
}
LEGACY_BALANCE_DROPPED = [
    "available_for_sale_assets", "lend_capital_liability", "other_equity_tools_PRE_STOCK",
    "other_equity_tools_PERPETUAL_DEBT", "other_equity_tools_OTHER", "total_liability_equity",
]
# --- end of fixed values ----------------------------------------------------


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that are there; a target that exists already is left alone."""
    todo = {a: b for a, b in names.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(todo)


def _add_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    gaps = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(gaps) if gaps else df


def _feed_day(df: DataFrame) -> DataFrame:
    if "day" not in df.columns and "trade_date" in df.columns:
        df = df.withColumn("day", from_compact("trade_date"))
    return df


def price_feed(raw: DataFrame, pre_adjusted: bool = False) -> DataFrame:
    """A price extract as ``price_data``.

    Plain feeds leave factors unknown. Pre-adjusted feeds carry prices that need no factor:
    ``adj_close`` is the close, a missing factor is 1, a missing suspension flag is 0.
    """
    schema = SCHEMAS["price_data"]
    df = _feed_day(renamed(raw, FEED_RENAMES)).withColumn("code", standard_code("code"))
    if pre_adjusted:
        factor = F.coalesce("factor", F.lit(1.0)) if "factor" in df.columns else F.lit(1.0)
        paused = F.coalesce("paused", F.lit(0)) if "paused" in df.columns else F.lit(0)
        df = df.withColumns({"factor": factor, "adj_factor": factor, "paused": paused,
                             "adj_close": F.col("close")})
    df = _add_missing(df, schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def daily_basic_feed(raw: DataFrame) -> DataFrame:
    schema = SCHEMAS["daily_basic"]
    df = _feed_day(renamed(raw, {"ts_code": "code"})).withColumn("code", standard_code("code"))
    df = _add_missing(df, schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def statement_feed(raw: DataFrame) -> DataFrame:
    """A statement extract: standard code, and ``stat_date`` from ``report_date`` when absent."""
    df = renamed(raw, CAMEL_RENAMES).withColumn("code", standard_code("code"))
    if "stat_date" not in df.columns and "report_date" in df.columns:
        df = df.withColumn("stat_date", F.col("report_date"))
    dates = [c for c in ("stat_date", "pub_date", "report_date", "start_date", "end_date")
             if c in df.columns]
    return df.withColumns({c: parse_date(c) for c in dates})


def numeric_feed(raw: DataFrame, keys: Sequence[str] = ("code", "day", "pubDate", "statDate")) -> DataFrame:
    """Text columns outside the keys become numbers; what is no number becomes NULL."""
    texts = [f.name for f in raw.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name not in keys]
    df = raw.withColumns({c: to_number(c) for c in texts}) if texts else raw
    return df.withColumn("code", standard_code("code"))


def security_master(stocks: DataFrame, more: DataFrame | None, update_date: dt.date | str) -> DataFrame:
    """Security master rows of one or two listings of stocks."""
    df = stocks if more is None else stocks.unionByName(more, allowMissingColumns=True)
    code = standard_code(F.col("code").cast("string"))
    df = df.withColumn("code", code)
    df = df.withColumns({
        "exchange": exchange_of("code"), "market": market_of("code"),
        "security_type": F.lit("stock"), "status": F.lit("normal"),
        "is_st": is_special_treatment("display_name"), "update_date": as_day(update_date),
        "end_date": drop_far_future("end_date")})
    return align_to_schema(df, "stock_list")


def index_master(indices: DataFrame, update_date: dt.date | str) -> DataFrame:
    """Security master rows of indices: no board, no industry, never special treatment."""
    df = indices.withColumn("code", standard_code(F.col("code").cast("string")))
    df = df.withColumns({
        "exchange": exchange_of("code"), "market": F.lit(None).cast("string"),
        "security_type": F.lit("index"), "status": F.lit("normal"), "is_st": F.lit(False),
        "update_date": as_day(update_date), "end_date": drop_far_future("end_date")})
    return align_to_schema(df, "stock_list")


def align_to_schema(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Columns of the declared table in its order: extra ones dropped, missing ones NULL.

    The first of equally named columns counts; values that do not fit become NULL; text
    dates are read in any of the three usual forms.
    """
    schema = SCHEMAS[table] if isinstance(table, str) else table
    first: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name, i)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    types = [f.dataType for f in df.schema.fields]
    out = []
    for f in schema.fields:
        if f.name not in first:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        i = first[f.name]
        value = F.col(f"_{i}")
        if types[i] == f.dataType:
            fitted = value
        elif isinstance(f.dataType, T.DateType) and isinstance(types[i], T.StringType):
            fitted = F.coalesce(parse_date(value), value.try_cast("date"))
        else:
            fitted = value.try_cast(f.dataType)
        out.append(fitted.alias(f.name))
    return plain.select(*out)


def schema_diff(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """``column_name, status`` with missing, extra or common against the declared table."""
    target = (SCHEMAS[table] if isinstance(table, str) else table).fieldNames()
    rows = [(c, "common" if c in df.columns else "missing") for c in target]
    rows += [(c, "extra") for c in dict.fromkeys(df.columns) if c not in target]
    return df.sparkSession.createDataFrame(rows, "column_name string, status string")


def conform_columns(df: DataFrame, add: T.StructType | None = None,
                    drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Adds, renames and drops columns so that a table reaches its new shape."""
    out = renamed(df, rename or {})
    if add is not None:
        out = _add_missing(out, add)
    return out.drop(*drop)


def split_columns(df: DataFrame, keys: Sequence[str], families: Mapping[str, Sequence[str]]) \
        -> dict[str, DataFrame]:
    """One table per family of columns, each with the keys."""
    return {name: df.select(*keys, *[c for c in cols if c in df.columns])
            for name, cols in families.items()}


def clean_blanks(df: DataFrame) -> DataFrame:
    """Empty text and NaN to NULL in every column."""
    return df.select(*[blank_to_null(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def code_map(spark, path: str) -> DataFrame:
    """A CSV of old and new codes, by those names or else its first two columns."""
    df = spark.read.option("header", True).csv(path)
    names = ["old_code", "new_code"]
    picked = df.select(*names) if all(n in df.columns for n in names) \
        else df.select(*df.columns[:2]).toDF(*names)
    trimmed = picked.select(*[F.trim(c).alias(c) for c in names])
    return trimmed.filter((F.col("old_code") != "") & (F.col("new_code") != ""))
