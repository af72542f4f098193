"""Keyed writes and incremental loads.

The functions return the new state of a table, or the rows to add, as a lazy DataFrame;
``write_partitions`` and ``append`` put it on storage. Batches are brought to one row per
key with grouped aggregates, which combine on the map side, before they meet the table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.codes import preferred_feed
from quotemill.functions.dates import DAILY_BASIC_START, HISTORY_START, window_end, window_start
from quotemill.functions.dates import day as as_day
from quotemill.operators.calendar import off_calendar, on_calendar
from quotemill.operators.coverage import latest_dates
from quotemill.operators.dated import date_between
from quotemill.operators.ledger import split_valid
from quotemill.session import stored


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None,
                keep: str = "first") -> DataFrame:
    """One row per key: first or last in ``order`` (any one when no order is given).

    Key columns may not be part of the kept struct; rows with the same key and order value
    are told apart by their remaining columns, so the choice does not depend on partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = [F.col(c) if isinstance(c, str) else c for c in (order or [])]
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(chosen)],
                      *[F.col(c) for c in rest])
    fold = F.min(ranked) if keep == "first" else F.max(ranked)
    return df.groupBy(*keys).agg(fold.alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def insert_new(existing: DataFrame, new: DataFrame, keys: Sequence[str],
               order: Sequence[str | Column] | None = None) -> DataFrame:
    """Rows to append: one per key of the batch (the first in ``order``), without keys the table has."""
    return one_per_key(new, keys, order).join(existing.select(*keys), list(keys), "left_anti") \
        .select(*new.columns)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str],
                     order: Sequence[str] | None = None) -> DataFrame:
    """Table after an insert in which the row already there wins."""
    return existing.unionByName(insert_new(existing, new, keys, order), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str],
           order: Sequence[str | Column]) -> DataFrame:
    """Table after an insert in which the new row wins: the last of the batch in ``order``.

    Rows of a frame have no order of their own, so the caller names what tells late from early.
    """
    fresh = one_per_key(new, keys, order, keep="last")
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete_where(df: DataFrame, **equals) -> DataFrame:
    """Table without the rows that meet every condition. Unknown never counts as a match."""
    if not equals:
        raise ValueError("a delete needs at least one condition")
    hit = F.lit(True)
    for col, value in equals.items():
        hit = hit & (F.col(col) == F.lit(value))
    return df.filter(~F.coalesce(hit, F.lit(False)))


def update_where(df: DataFrame, values: Mapping[str, object], **equals) -> DataFrame:
    """Table with columns set on the rows that meet every condition."""
    if not equals:
        raise ValueError("an update needs at least one condition")
    hit = F.lit(True)
    for col, value in equals.items():
        hit = hit & (F.col(col) == F.lit(value))
    hit = F.coalesce(hit, F.lit(False))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.when(hit, F.lit(v).cast(types[c])).otherwise(F.col(c))
                           for c, v in values.items()})


def update_from(df: DataFrame, changes: DataFrame, keys: Sequence[str],
                order: Sequence[str] | None = None) -> DataFrame:
    """Many updates at once: non-null columns of ``changes`` replace those of matching rows."""
    cols = [c for c in changes.columns if c not in keys and c in df.columns]
    new = one_per_key(changes.select(*keys, *cols), keys, order, keep="last") \
        .withColumnsRenamed({c: f"_new_{c}" for c in cols})
    joined = df.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c)
                           for c in df.columns])


def import_trades(existing: DataFrame, batch: DataFrame,
                  by: Sequence[str] = ("trade_date",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted trades, trades already in the table, and counts of both per ``by``.

    Repeats of one id inside the batch count once as accepted.
    """
    known = existing.select("trade_id").distinct()
    duplicates = batch.join(known, "trade_id", "left_semi").select(*batch.columns)
    accepted = insert_new(existing, batch, ["trade_id"])
    counts = accepted.groupBy(*by).agg(F.count(F.lit(1)).alias("accepted")).join(
        duplicates.groupBy(*by).agg(F.count(F.lit(1)).alias("duplicates")), list(by), "full_outer")
    return accepted, duplicates, counts.select(
        *by, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("accepted", "duplicates")])


def import_snapshots(existing: DataFrame, batch: DataFrame, overwrite: bool = False,
                     keys: Sequence[str] = ("user_id", "position_date")) -> tuple[DataFrame, DataFrame]:
    """New state and refused rows. A (user, date) already there is refused, or replaced."""
    pairs = _keyed(batch, keys)
    if overwrite:
        kept = existing.join(pairs, list(keys), "left_anti").select(*existing.columns)
        return kept.unionByName(batch, allowMissingColumns=True), batch.limit(0)
    there = _keyed(existing, keys)
    refused = batch.join(there, list(keys), "left_semi").select(*batch.columns)
    fresh = batch.join(there, list(keys), "left_anti").select(*batch.columns)
    return existing.unionByName(fresh, allowMissingColumns=True), refused


def reimport(existing: DataFrame, batch: DataFrame, keys: Sequence[str] = ("user_id", "trade_date")) \
        -> DataFrame:
    """Delete every (account, date) the batch holds, then load it."""
    return import_snapshots(existing, batch, overwrite=True, keys=keys)[0]


def on_import_days(files: DataFrame, calendar: DataFrame, dates: Sequence | None = None,
                   accounts: Sequence[str] | None = None, date_col: str = "file_date",
                   account_col: str = "user_id") -> DataFrame:
    """Rows of the asked dates and accounts, trading days only."""
    if dates is not None:
        files = files.filter(F.col(date_col).isin([as_day(d) for d in dates]))
    if accounts is not None:
        files = files.filter(F.col(account_col).isin(list(accounts)))
    return on_calendar(files, calendar, date_col)


# --- load windows -----------------------------------------------------------

def load_plan(securities: DataFrame, tables: Mapping[str, tuple[DataFrame, str]],
              as_of: dt.date | str, end: dt.date | str | None = None, full: bool = False,
              floor: dt.date = HISTORY_START) -> DataFrame:
    """``code, table_name, latest, start_day, end_day, skip, feed`` for every code and table.

    Starts the day after the newest row, or at listing (never before ``floor``).
    """
    parts = []
    for name, (df, date_col) in tables.items():
        newest = latest_dates(df, securities, date_col).withColumnRenamed("max_date", "latest")
        rows = securities.select("code", "start_date", "end_date").join(newest, "code", "left")
        first = window_start("start_date", floor)
        start = first if full else F.coalesce(F.date_add("latest", 1), first)
        given = None if end is None else as_day(end)
        if full:
            stop = window_end(given, "end_date", as_of)
        else:
            stop = F.least(F.coalesce(given if given is not None else as_day(as_of),
                                      as_day(as_of)), as_day(as_of))
        parts.append(rows.select(
            "code", F.lit(name).alias("table_name"), "latest", start.alias("start_day"),
            stop.alias("end_day"), (start > stop).alias("skip"),
            preferred_feed("code", name).alias("feed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def apply_plan(plan: DataFrame, feed: DataFrame, table: str, date_col: str = "day") -> DataFrame:
    """Feed rows that fall in their code's open window."""
    windows = plan.filter((F.col("table_name") == table) & ~F.col("skip")).select(
        F.col("code").alias("_code"), "start_day", "end_day")
    cond = ((F.col("code") == F.col("_code")) & (F.col(date_col) >= F.col("start_day"))
            & (F.col(date_col) <= F.col("end_day")))
    return feed.join(windows, cond).select(*feed.columns)


def batch_window(table_df: DataFrame, feed: DataFrame, as_of: dt.date | str, date_col: str = "day",
                 single_day: dt.date | str | None = None, full: bool = False,
                 daily_basic: bool = False) -> DataFrame:
    """Feed rows newer than the table's newest date, up to ``as_of``; or one given day."""
    if single_day is not None:
        return date_between(feed, date_col, single_day, single_day)
    floor = F.lit(DAILY_BASIC_START if daily_basic else HISTORY_START)
    rows = date_between(feed, date_col, end=as_of)
    if full:
        return date_between(rows, date_col, floor)
    newest = table_df.agg(F.max(date_col)).scalar()
    return date_between(rows, date_col, F.coalesce(F.date_add(newest, 1), floor))


def route_feeds(primary: DataFrame, secondary: DataFrame, table: str = "price_data") -> DataFrame:
    """Each code from its own feed."""
    return primary.filter(preferred_feed("code", table) == "primary").unionByName(
        secondary.filter(preferred_feed("code", table) == "secondary"), allowMissingColumns=True)


def master_is_stale(securities: DataFrame, as_of: dt.date | str, days: int = 7) -> DataFrame:
    newest = F.max("update_date")
    return securities.agg(newest.alias("update_date"), F.count(F.lit(1)).alias("n_rows")).select(
        "update_date", "n_rows",
        (F.col("update_date").isNull() | (F.datediff(as_day(as_of), "update_date") > days))
        .alias("stale"))


# Fixed value: months in which quarterly reports come out.
REPORT_MONTHS = (4, 5, 8, 9, 10, 11)


def financials_due(statements: Sequence[DataFrame], as_of: dt.date | str, days: int = 90) -> DataFrame:
    newest = [s.agg(F.max("stat_date").alias("d")) for s in statements]
    rows = newest[0]
    for n in newest[1:]:
        rows = rows.unionAll(n)
    today = as_day(as_of)
    return rows.agg(F.max("d").alias("newest")).select(
        "newest", (F.month(today).isin(*REPORT_MONTHS)
                   | F.coalesce(F.datediff(today, "newest") > days, F.lit(False))).alias("due"))


def load_master(existing: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New security master after a refresh, and the listed rows that were refused.

    ``listing`` comes from ``security_master`` or ``index_master``; new rows replace old ones.
    """
    good, rejects = split_valid(listing, "stock_list")
    return upsert(existing, good, ["code"], ["update_date"]), rejects


def reload_check(stored: DataFrame, loaded: DataFrame, keys: Sequence[str] = ("code", "stat_date"),
                 version: str = "report_type") -> DataFrame:
    """One row after a reload or re-keying: rows on both sides, keys, keys with versions."""
    per_key = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                        F.count_distinct(version).alias("v"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("stored_rows"),
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("v") > 1).alias("versioned_keys")) \
        .withColumn("loaded_rows", loaded.agg(F.count(F.lit(1)).alias("n")).scalar()) \
        .withColumn("complete", F.col("stored_rows") == F.col("loaded_rows"))


# --- clean-up and re-keying -------------------------------------------------

def non_trading_preview(df: DataFrame, calendar: DataFrame, date_col: str,
                        user_col: str = "user_id", code_col: str | None = "stock_code") -> DataFrame:
    rows = off_calendar(df, calendar, date_col)
    stats = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(user_col).alias("n_users")]
    if code_col:
        stats.append(F.count_distinct(code_col).alias("n_codes"))
    return rows.groupBy(date_col).agg(*stats)


def drop_non_trading_days(df: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    return on_calendar(df, calendar, date_col)


def _digits_ok() -> Column:
    return (F.col("old_code").cast("string").rlike("^[0-9]{1,6}$")
            & F.col("new_code").cast("string").rlike("^[0-9]{1,6}$"))


def code_map_rejects(code_map: DataFrame) -> DataFrame:
    """Map rows that ``remap_codes`` does not use."""
    return code_map.filter(~F.coalesce(_digits_ok(), F.lit(False)))


def remap_codes(df: DataFrame, code_map: DataFrame, suffix: str = ".BJ") -> DataFrame:
    """Old exchange codes to new ones (``old_code, new_code``, digits only).

    A map row may carry its old code as number or text; other codes stay. Map rows whose codes are not
    one to six digits name no exchange code and are left out; ``code_map_rejects`` lists them.
    """
    pairs = code_map.filter(_digits_ok()).select(
        F.concat(F.lpad(F.col("old_code").cast("string"), 6, "0"), F.lit(suffix)).alias("_old"),
        F.concat(F.lpad(F.col("new_code").cast("string"), 6, "0"), F.lit(suffix)).alias("_new")) \
        .groupBy("_old").agg(F.min("_new").alias("_new"))
    return df.join(pairs, F.col("code") == F.col("_old"), "left").select(
        *[F.coalesce("_new", "code").alias("code") if c == "code" else F.col(c) for c in df.columns])


def remap_report(df: DataFrame, code_map: DataFrame, suffix: str = ".BJ",
                 keys: Sequence[str] = ("code", "day")) -> DataFrame:
    """Rows to be renamed per code, and how many would meet a key already there."""
    moved = remap_codes(df.withColumn("_from", F.col("code")), code_map, suffix) \
        .filter(F.col("code") != F.col("_from"))
    there = df.select(*keys).withColumn("_hit", F.lit(1)).distinct()
    return moved.join(there, list(keys), "left").groupBy(
        F.col("_from").alias("old_code"), F.col("code").alias("new_code")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_hit").alias("n_collisions"))


def with_version_key(df: DataFrame, keys: Sequence[str] = ("code", "stat_date"),
                     version: str = "report_type") -> DataFrame:
    """Re-keys a table by a version column; an unknown version is 0."""
    if version not in df.columns:
        df = df.withColumn(version, F.lit(None).cast("int"))
    known = df.withColumn(version, F.coalesce(F.col(version), F.lit(0)))
    return one_per_key(known, [*keys, version])


def fill_factors(bars: DataFrame, feed: DataFrame, suffix: str | None = ".BJ") -> DataFrame:
    """Sets ``adj_factor`` and ``factor`` from a factor feed by code and day."""
    new = feed.groupBy(F.col("code").alias("_c"), F.col("day").alias("_d")).agg(
        F.max("adj_factor").alias("_f"))
    cond = (F.col("code") == F.col("_c")) & (F.col("day") == F.col("_d"))
    if suffix:
        cond = cond & F.col("code").endswith(suffix)
    joined = bars.join(new, cond, "left")
    return joined.select(*[F.coalesce("_f", c).alias(c) if c in ("factor", "adj_factor")
                           else F.col(c) for c in bars.columns])


# --- storage ----------------------------------------------------------------

def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replaces exactly the partitions ``df`` holds; the others stay as they are.

    Files are staged by the write job and moved in when it commits, so a lost executor only
    costs its tasks, and ``df`` may read the very path it is written to.
    """
    if not partition_by:
        raise ValueError("partition columns are needed to replace part of a table")
    # rebalance: AQE splits a partition value that holds much of the data and merges small ones.
    (df.hint("rebalance", *partition_by)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*partition_by).parquet(path))


def touched_partitions(existing: DataFrame, new: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of the table that live in partitions the batch writes to."""
    return existing.join(_keyed(new, partition_by), list(partition_by), "left_semi") \
        .select(*existing.columns)


# --- changes of stored tables that write only the folders they touch ---------

def folder_rows(table: DataFrame, partition_by: str, values: Sequence) -> DataFrame:
    """The rows of the named folders: values are literals, so the other folders are not even listed as input."""
    known = [v for v in values if v is not None]
    hit = F.col(partition_by).isin(known)
    return table.filter(hit | F.col(partition_by).isNull() if len(known) < len(values) else hit)


def partition_values(df: DataFrame, partition_by: str) -> list:
    """Partition values, fetched: one per folder that a change touches."""
    return [r[0] for r in df.select(partition_by).distinct().collect()]


def replace_folders(spark, path: str, partition_by: str, values: Sequence, new_rows: DataFrame) -> None:
    """Puts ``new_rows`` in place of the named folders; folders nothing is left for are removed.

    The rows are stored first, so a write that fails and runs again finds them, and the table is read once.
    """
    rows = stored(new_rows, "touched")
    write_partitions(rows, path, [partition_by])
    left = {str(v) for v in partition_values(rows, partition_by)}
    for v in values:
        if str(v) not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if v is None else v
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{partition_by}={name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert_stored(path: str, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  partition_by: str) -> list:
    """``upsert`` into a stored table, writing only folders that hold keys of the batch or get rows of it.

    Key columns and the partition column are read to find those folders (a key may move to another one);
    where the partition column is one of the keys, the batch alone names them. Returns the folders'
    values, one per folder touched. ``order`` columns that the table lacks only order the batch.
    """
    spark = new.sparkSession
    table = spark.read.parquet(path)
    fresh = stored(one_per_key(new, keys, order, keep="last").select(*table.columns), "batch")
    values = set(partition_values(fresh, partition_by))
    if partition_by not in keys:
        held = table.select(*keys, partition_by).join(fresh.select(*keys), list(keys), "left_semi")
        values |= set(partition_values(held, partition_by))
    values = sorted(values, key=lambda v: (v is None, str(v)))
    kept = folder_rows(spark.read.parquet(path), partition_by, values).join(fresh.select(*keys), list(keys), "left_anti")
    replace_folders(spark, path, partition_by, values, kept.select(*table.columns).unionByName(fresh))
    return values


def _matching(spark, path: str, partition_by: str, equals: Mapping) -> tuple[DataFrame, Column, list]:
    if not equals:
        raise ValueError("a change needs at least one condition")
    table = spark.read.parquet(path)
    hit = F.lit(True)
    for col, value in equals.items():
        hit = hit & (F.col(col) == F.lit(value))
    hit = F.coalesce(hit, F.lit(False))
    return table, hit, partition_values(table.filter(hit), partition_by)


def delete_stored(spark, path: str, partition_by: str, **equals) -> list:
    """``delete_where`` on a stored table; only folders with matching rows are written. Returns their values."""
    table, hit, values = _matching(spark, path, partition_by, equals)
    if values:
        replace_folders(spark, path, partition_by, values, folder_rows(table, partition_by, values).filter(~hit))
    return values


def update_stored(spark, path: str, partition_by: str, changes: Mapping[str, object], **equals) -> list:
    """``update_where`` on a stored table; only folders with matching rows are written. Returns their values."""
    if partition_by in changes:
        raise ValueError("rows do not change folders by an update: use upsert_stored")
    table, hit, values = _matching(spark, path, partition_by, equals)
    if values:
        rows = folder_rows(table, partition_by, values)
        replace_folders(spark, path, partition_by, values, update_where(rows, changes, **equals))
    return values


# --- contents compared by order-free sums ------------------------------------

LEAVES = 4096


def _sums(columns: Sequence[str]) -> list[Column]:
    """Row count and four sums of two 64-bit row hashes, cut in halves so that sums of 2^31 rows fit a long."""
    out = [F.count(F.lit(1)).alias("n")]
    for i in range(2):
        h = F.xxhash64(F.lit(i), *[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])
        out += [F.sum(F.shiftright(h, 32)).alias(f"h{i}"),
                F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"l{i}")]
    return out


_SUMS = ["n", "h0", "l0", "h1", "l1"]


def _leaf(keys: Sequence[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def content_sums(df: DataFrame, keys: Sequence[str], range_col: str, leaves: int = LEAVES) -> DataFrame:
    """The contents of a table in a few numbers per range (a year, say) and leaf of hashed keys.

    Sums are order-free and mergeable, so they can be kept beside a table and compared later. All other
    columns take part. One scan, partial sums on the map side, at most ``ranges * leaves`` rows.
    """
    rest = sorted(c for c in df.columns if c not in keys and c != range_col)
    return df.groupBy(range_col, _leaf(keys, leaves).alias("leaf")).agg(*_sums([*keys, *rest]))


def _unequal(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose sums differ, with the row counts of both sides; NULL groups meet each other."""
    sides = left.select(*by, F.lit(1).alias("_side"), *_SUMS).unionByName(
        right.select(*by, F.lit(-1).alias("_side"), *_SUMS))
    folded = sides.groupBy(*by).agg(
        *[F.sum(F.col(c) * F.col("_side")).alias(c) for c in _SUMS],
        F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("n"))), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(F.col("_side") == -1, F.col("n"))), F.lit(0)).alias("right_rows"))
    differs = F.lit(False)
    for c in _SUMS:
        differs = differs | (F.col(c) != 0)
    return folded.filter(differs).select(*by, "left_rows", "right_rows")


def content_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], range_col: str,
                 leaves: int = LEAVES, left_sums: DataFrame | None = None,
                 right_sums: DataFrame | None = None) -> DataFrame:
    """``keys, left_rows, right_rows, state`` of the keys whose rows differ: missing, extra or changed.

    Sums of ranges and leaves are compared first (those kept from a load may be given); only leaves that
    differ are opened, and ranges without any are not read where ``range_col`` is a folder column. Keys
    may repeat: their rows are compared as a multiset. The differing leaves are fetched to name the ranges.
    """
    a = content_sums(left, keys, range_col, leaves) if left_sums is None else left_sums
    b = content_sums(right, keys, range_col, leaves) if right_sums is None else right_sums
    # One small file by a shuffle of what differs; merging partitions instead would run all of the comparison in one task.
    bad = stored(_unequal(a, b, [range_col, "leaf"]).select(range_col, "leaf").repartition(1), "leaves")
    ranges = partition_values(bad, range_col)
    columns = sorted(c for c in left.columns if c not in keys and c != range_col)

    def opened(df: DataFrame) -> DataFrame:
        known = [v for v in ranges if v is not None]
        hit = F.col(range_col).isin(known)
        rows = df.filter(hit | F.col(range_col).isNull() if len(known) < len(ranges) else hit) \
            .withColumn("leaf", _leaf(keys, leaves))
        wanted = bad.select(F.col(range_col).alias("_range"), F.col("leaf").alias("_leaf"))
        near = rows.join(wanted, F.col(range_col).eqNullSafe(F.col("_range")) & (F.col("leaf") == F.col("_leaf")),
                         "left_semi")
        return near.groupBy(*keys).agg(*_sums([range_col, *columns]))

    found = _unequal(opened(left), opened(right), keys)
    return found.withColumn("state", F.when(F.col("left_rows") == 0, "extra")
                            .when(F.col("right_rows") == 0, "missing").otherwise("changed"))
