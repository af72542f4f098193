"""Versioned quarterly fundamentals, point-in-time reads and source reconciliation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.conditions import gap_share
from quotemill.functions.dates import day as as_day
from quotemill.functions.values import ratio
from quotemill.schemas import FLOW_COLUMNS
from quotemill.session import stored


def latest_version(df: DataFrame, keys: Sequence[str] = ("code", "stat_date"),
                   version: str = "report_type", tie_break: Sequence[str] = ("pub_date",)) -> DataFrame:
    """One row per key: the highest version (a missing version ranks lowest)."""
    order = [F.col(version).desc_nulls_last()]
    order += [F.col(c).desc_nulls_last() for c in tie_break if c in df.columns]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def one_version(df: DataFrame, version_value: int, version: str = "report_type") -> DataFrame:
    return df.filter(F.col(version) == version_value)


def version_distribution(df: DataFrame, version: str = "report_type") -> DataFrame:
    return df.groupBy(version).agg(F.count(F.lit(1)).alias("n_rows"))


def multi_version_keys(df: DataFrame, keys: Sequence[str] = ("code", "stat_date")) -> DataFrame:
    """How many keys carry more than one version."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count_if(F.col("n") > 1).alias("multi_version_keys"),
                       F.count(F.lit(1)).alias("total_keys"))


def asof_or_latest(df: DataFrame, start: dt.date | str, end: dt.date | str,
                   date_col: str = "pub_date", n: int = 10,
                   tie_break: Sequence[str] = ("stat_date",)) -> DataFrame:
    """Rows of each code inside the range; for codes without any, their newest rows.

    At most ``n`` rows per code. In-range rows sort first, so the rank cut (made on both
    sides of the shuffle) keeps them before any other, and only the survivors are compared.
    """
    inside = F.coalesce(F.col(date_col).between(as_day(start), as_day(end)), F.lit(False))
    w = Window.partitionBy("code").orderBy(
        F.col("_in").desc(), F.col(date_col).desc_nulls_last(),
        *[F.col(c).desc_nulls_last() for c in tie_break])
    cut = df.withColumn("_in", inside).withColumn("_n", F.row_number().over(w)) \
        .filter(F.col("_n") <= n)
    any_in = F.max("_in").over(Window.partitionBy("code"))
    return cut.withColumn("_any", any_in).filter(F.col("_in") | ~F.col("_any")) \
        .withColumnRenamed("_in", "in_range").drop("_n", "_any")


#: Order of statements known at the same time: the newest quarter, in it the highest version.
NEWEST = ("stat_date", "report_type", "pub_date")


def known_spans(statements: DataFrame, order: Sequence[str] = NEWEST, known: str = "pub_date") -> DataFrame:
    """``code, from_day, until_day`` (exclusive, NULL for open) and ``statement``, the best known then.

    A statement published late for an older quarter does not replace a newer quarter's. Per code there
    are a few statements a year; rows of one code and publication day are folded first.
    """
    rest = [c for c in statements.columns if c not in ("code", *order)]
    best = F.struct(*order, *rest)
    per_day = statements.filter(F.col("code").isNotNull() & F.col(known).isNotNull()) \
        .groupBy("code", F.col(known).alias("from_day")).agg(F.max(best).alias("_best"))
    in_time = Window.partitionBy("code").orderBy("from_day")
    held = per_day.withColumn("statement", F.max("_best").over(
        in_time.rowsBetween(Window.unboundedPreceding, 0)))
    turns = held.withColumn("_before", F.lag("statement").over(in_time)) \
        .filter(~F.col("statement").eqNullSafe(F.col("_before")))
    return turns.select("code", "from_day", F.lead("from_day").over(in_time).alias("until_day"), "statement")


def with_known_statement(bars: DataFrame, statements: DataFrame, day: str = "day",
                         order: Sequence[str] = NEWEST, known: str = "pub_date") -> DataFrame:
    """Every bar with the statement known on its day (struct ``statement``, NULL before the first one).

    Spans are dealt into quarters, so a bar meets the two or three spans of its code and quarter and not
    all of the code's history. Bars are shuffled once, by code and quarter; a hot one is split by AQE, and
    no window runs over bars. Bars without code or day keep a NULL statement; repeated bars stay.
    """
    def quarter(c: Column) -> Column:
        return F.year(c) * 4 + F.quarter(c)

    last = bars.agg(F.max(day)).scalar()
    spans = known_spans(statements, order, known).withColumn("_last", last)
    end = F.least(F.date_sub(F.coalesce("until_day", F.date_add("_last", 1)), 1), F.col("_last"))
    dealt = spans.filter(F.col("from_day") <= F.col("_last")).select(
        F.col("code").alias("_code"), "from_day", "until_day", "statement",
        F.explode(F.sequence(quarter(F.col("from_day")), quarter(end))).alias("_quarter"))
    meets = ((F.col("code") == F.col("_code")) & (quarter(F.col(day)) == F.col("_quarter"))
             & (F.col(day) >= F.col("from_day"))
             & (F.col("until_day").isNull() | (F.col(day) < F.col("until_day"))))
    return bars.join(dealt, meets, "left").select(*[bars[c] for c in bars.columns], "statement")


def merge_margin_and_flow(margin: DataFrame, flow: DataFrame) -> DataFrame:
    """All (code, day) of either feed with the columns of both."""
    flow_cols = [c for c in FLOW_COLUMNS if c in flow.columns]
    return margin.join(flow.select("code", "day", *flow_cols), ["code", "day"], "full_outer")


def one_sided_codes(margin: DataFrame, flow: DataFrame) -> DataFrame:
    """Codes that only one of the two feeds knows, in one pass over each."""
    seen = (margin.select("code", F.lit(1).alias("m"), F.lit(0).alias("f"))
            .unionAll(flow.select("code", F.lit(0).alias("m"), F.lit(1).alias("f"))))
    return (seen.groupBy("code").agg(F.max("m").alias("m"), F.max("f").alias("f"))
            .filter(F.col("m") != F.col("f"))
            .select("code", F.when(F.col("m") == 1, F.lit("margin_only"))
                    .otherwise(F.lit("flow_only")).alias("side")))


def balance_errors(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Statements whose assets differ from liabilities plus equity by more than 1%."""
    err = gap_share("total_assets", "total_liability", "total_sheet_owner_equities")
    return df.withColumn("error_ratio", err).filter(F.col("error_ratio") > tolerance)


def market_cap_errors(prices: DataFrame, valuation: DataFrame, tolerance: float = 0.05,
                      cap_unit: float = 1e8, share_unit: float = 1e4) -> DataFrame:
    """Valuations whose market cap is not price times shares (units differ between the two)."""
    stated = F.col("market_cap") * cap_unit
    implied = F.col("close") * F.col("capitalization") * share_unit
    return (prices.select("code", "day", "close")
            .join(valuation.select("code", "day", "market_cap", "capitalization"), ["code", "day"])
            .withColumn("error_ratio", ratio(F.abs(stated - implied), F.abs(stated)))
            .filter(F.col("error_ratio") > tolerance))


# --- reconciliation of two sources ------------------------------------------

def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.to_date(c).cast("string")
    return c.cast("string")


def _differs(x: Column, y: Column, numeric: bool, atol: float, rtol: float) -> Column:
    same = x.eqNullSafe(y)
    if numeric:
        x, y = x.cast("double"), y.cast("double")
        same = x.eqNullSafe(y) | F.coalesce(
            F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y), F.lit(False))
    return ~same


def _overlap(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Whether two ascending neighbours are so close that values around them may be within the tolerance."""
    return b - a <= F.lit(atol) + F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))


def matched(left: list[tuple], right: list[tuple], numeric: Sequence[bool], atol: float, rtol: float) -> int:
    """The largest number of pairs of a left and a right row that agree in all columns within the tolerance.

    Both lists are in order of the first number, and a row's partners lie in a stretch of the other list. Each row
    takes its first free partner; where it has none, partners are handed on along augmenting paths.
    """
    lead = next((i for i, n in enumerate(numeric) if n), None)

    def near(x, y) -> bool:
        if x is None or y is None or x != x or y != y:
            return x is y or (x is not None and y is not None and x != x and y != y)
        return x == y or abs(x - y) <= atol + rtol * abs(y)

    def agree(x: tuple, y: tuple) -> bool:
        return all(near(u, v) if n else u == v for u, v, n in zip(x, y, numeric))

    def order(row: tuple) -> tuple:
        v = row[lead] if lead is not None else None
        return (2, 0.0) if v is None else (1, 0.0) if v != v else (0, v)

    left, right = sorted(left, key=order), sorted(right, key=order)
    partners, low = [], 0
    for x in left:
        v = order(x)
        if v[0] == 0 and abs(v[1]) != float("inf"):
            reach = 2 * (atol + rtol * abs(v[1])) + 1e-300
            while low < len(right) and order(right[low]) < (0, v[1] - reach):
                low += 1
            high = low
            while high < len(right) and order(right[high]) <= (0, v[1] + reach):
                high += 1
            stretch = range(low, high)
        else:
            stretch = range(len(right)) if lead is None else (j for j in range(len(right)) if order(right[j]) == v)
        partners.append([j for j in stretch if agree(x, right[j])])
    of_left: list[int | None] = [None] * len(left)
    of_right: list[int | None] = [None] * len(right)
    pairs = 0
    for start in range(len(left)):
        came, queue, end = {}, [start], None  # breadth first over rows of the left side
        while queue and end is None:
            for i in list(queue):
                queue.remove(i)
                for j in partners[i]:
                    if j in came:
                        continue
                    came[j] = i
                    if of_right[j] is None:
                        end = j
                        break
                    queue.append(of_right[j])
                if end is not None:
                    break
        pairs += end is not None
        while end is not None:  # hand partners on along the path, back to the row it began with
            i = came[end]
            given_up, of_right[end], of_left[i] = of_left[i], i, end
            end = given_up
    return pairs


def _repeated(dealt: DataFrame, keys: list[str], numeric: list[bool], atol: float, rtol: float) -> DataFrame:
    """``keys, _total`` of keys with as many rows on both sides, more than one, that may not all be matched; ``_hard``.

    ``dealt``: the keys, _left and the values _c0.. of all rows, dealt by the keys, so that nothing here is shuffled again.
    Equal rows of a key are counted once, per side, and what both sides have is taken off: two equal rows can always be each
    other's partners. What is left of a key is cut into runs: sorted by its first number, a run ends where the next value
    is out of the tolerance's reach, so no pair lies across two runs and each is matched by itself. Rows of runs that cannot
    match have no ``_hard``; those of runs to be matched row by row have it, with their run, number and values.
    """
    names = [f"_c{i}" for i in range(len(numeric))]
    lead = next((i for i, n in enumerate(numeric) if n), None)

    def value(c: str, number: bool) -> Column:
        x = F.col(c).cast("double") + 0.0
        return F.when(~F.isnan(x), x).alias(c) if number else F.col(c)

    # NULL and NaN are told apart by a mark: NaN has no place in the order of a run
    marks = F.concat(F.lit(""), *[F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)).cast("string")
                                  for c, n in zip(names, numeric) if n])
    wide = dealt.select(*keys, "_left", *[value(c, n) for c, n in zip(names, numeric)], marks.alias("_nan"))
    exact = [*[c for c, n in zip(names, numeric) if not n], "_nan"]
    close = [c for c, n in zip(names, numeric) if n]
    # one sort serves all windows down to the runs
    placed = wide.sortWithinPartitions(*keys, *exact, *close, "_left")
    of_key = Window.partitionBy(*keys)
    totals = placed.withColumns({"_total": F.count_if("_left").over(of_key), "_other": F.count_if(~F.col("_left")).over(of_key)}) \
        .where("_total = _other AND _total > 1")
    # partners agree in all that has no tolerance, so those columns part the rows as well
    group = Window.partitionBy(*keys, *exact)
    sign = F.sum(F.when(F.col("_left"), 1).otherwise(-1))
    row = F.struct("_n", *exact, *close)
    if lead is None:  # nothing has a tolerance: what does not cancel out differs
        left_over = totals.withColumn("_n", sign.over(group)).where("_n <> 0")
        return left_over.select(*keys, "_total", F.when(F.lit(False), F.struct(F.lit(0).cast("bigint").alias("_run"), row.alias("_row"))).alias("_hard"))
    order = group.orderBy(*close)
    net = totals.withColumns({"_n": sign.over(order.rangeBetween(Window.currentRow, Window.currentRow)), "_peers": F.rank().over(order),
                              "_place": F.row_number().over(group.orderBy(*close, "_left"))}).where("_n <> 0 AND _place = _peers")
    first = F.col(f"_c{lead}")
    before = F.lag(first).over(order)
    cut = F.coalesce(~_overlap(before, first, 2 * atol, 2 * rtol), F.lit(True)) & ~(before.eqNullSafe(first))
    runs = net.withColumn("_cut", cut.cast("long")).withColumn(
        "_run", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a run whose sides differ in size cannot match; one row a side is compared here, more are matched row by row
    of_run = Window.partitionBy(*keys, *exact, "_run")
    sides = {f"{t}{c}": F.max(F.when(F.col("_n") * sign > 0, F.col(c))).over(of_run) for t, sign in (("l", 1), ("r", -1)) for c in close}
    sized = runs.withColumns({"_over": F.sum("_n").over(of_run), "_rows": F.sum(F.abs("_n")).over(of_run), **sides})
    apart = reduce(Column.__or__, [_differs(F.col(f"l{c}"), F.col(f"r{c}"), True, atol, rtol) for c in close])
    several = (F.col("_over") == 0) & (F.col("_rows") > 2)
    return sized.where((F.col("_over") != 0) | (F.col("_rows") > 2) | apart).select(
        *keys, "_total", F.when(several, F.struct("_run", row.alias("_row"))).alias("_hard"))


def _run_differs(numeric: list[bool], atol: float, rtol: float):
    """Whether the rows of a run (number, left above zero, and values) cannot all be matched."""
    def differs(rows: list) -> bool:
        sides: tuple[list, list] = ([], [])
        for n, *row in rows:
            sides[n < 0].extend([tuple(row)] * abs(n))
        return len(sides[0]) != len(sides[1]) or matched(*sides, numeric, atol, rtol) < len(sides[0])

    return F.udf(differs, "boolean")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str],
              atol: float = 1e-9, rtol: float = 1e-9,
              skip: Sequence[str] = ("id",)) -> DataFrame:
    """Differences between two sources as ``(keys..., issue, column_name, left_value, right_value)``.

    ``issue`` is ``left_only`` or ``right_only`` (key on one side), ``row_count`` (different
    number of rows for the key), ``repeated`` (same number above one, contents differ) or
    ``value`` (one cell). Both sides are read and shuffled once, by key; all else happens where the rows lie, so they
    travel as bare values, without sums or hashes. A key's rows are never compared pair by pair, but all of a hot key's
    go through one task (sorted there, spilling). NULL keys meet each other.

    Rows of repeated keys are matched with each other within the tolerance, over all columns: they differ
    if no way of pairing them off leaves every pair equal. What is found is stored (eager); runs of several rows a side
    are matched when the result is asked for.
    """
    keys = list(keys)
    shared = [c for c in left.columns
              if c in right.columns and c not in keys and c not in skip]
    types = {f.name: f.dataType for f in left.schema.fields}
    numeric = {c: isinstance(types[c], T.NumericType) for c in shared}

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        own = {f.name: f.dataType for f in df.schema.fields}

        def value(c: str) -> Column:
            if not numeric[c]:
                return _as_text(F.col(c), own[c])
            return F.col(c) if isinstance(own[c], T.NumericType) else F.col(c).try_cast("double")

        return df.select(*keys, F.lit(is_left).alias("_left"),
                         *[value(c).alias(f"_c{i}") for i, c in enumerate(shared)])

    def of(is_left: bool, c: Column) -> Column:
        return F.when(F.col("_left") == is_left, c)

    rows = side(left, True).unionByName(side(right, False))
    dealt = rows.repartition(*keys)
    both = dealt.groupBy(*keys).agg(
        *[F.count(of(s, F.lit(1))).alias(f"{t}_n") for s, t in ((True, "l"), (False, "r"))],
        *[F.max(of(s, F.col(f"_c{i}"))).alias(f"{t}_{i}")
          for s, t in ((True, "l"), (False, "r")) for i in range(len(shared))])

    def issue(kind: str, column: Column, lv: Column, rv: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue"), column.cast("string").alias("column_name"),
                        lv.cast("string").alias("left_value"),
                        rv.cast("string").alias("right_value"))

    none = F.lit(None).cast("string")
    l_n, r_n = F.col("l_n"), F.col("r_n")
    in_both = (l_n > 0) & (r_n > 0)
    found = [
        F.when(r_n == 0, issue("left_only", none, l_n, none)),
        F.when(l_n == 0, issue("right_only", none, none, r_n)),
        F.when(in_both & (l_n != r_n), issue("row_count", none, l_n, r_n)),
    ]
    for i, c in enumerate(shared):
        a, b = F.col(f"l_{i}"), F.col(f"r_{i}")
        found.append(F.when((l_n == 1) & (r_n == 1) & _differs(a, b, numeric[c], atol, rtol),
                            issue("value", F.lit(c), a, b)))
    plain = both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_i")).select(*keys, "_i.*")
    if not shared:
        return plain
    flags = [numeric[c] for c in shared]
    open_rows = _repeated(dealt, keys, flags, atol, rtol).select(
        *keys, F.lit("repeated").alias("issue"), none.alias("column_name"), F.col("_total").cast("string").alias("left_value"),
        F.col("_total").cast("string").alias("right_value"), "_hard")
    seen = stored(plain.unionByName(open_rows, allowMissingColumns=True), "differences")
    issue_columns = [*keys, "issue", "column_name", "left_value", "right_value"]
    known, repeated = seen.where("_hard IS NULL"), F.col("issue") == "repeated"
    exact = [F.col(f"_hard._row.{c}").alias(f"_e{i}") for i, c in enumerate(
        [*[f"_c{i}" for i, n in enumerate(flags) if not n], "_nan"])]
    hard = seen.where("_hard IS NOT NULL").groupBy(*issue_columns, *exact, F.col("_hard._run").alias("_run")) \
        .agg(F.collect_list("_hard._row").alias("_rows"))
    # in a row the values without tolerance come first, then the numbers
    differs = _run_differs([False] * len(exact) + [True] * sum(flags), atol, rtol)
    bad = hard.where(differs("_rows")).select(*issue_columns)
    return known.where(~repeated).select(*issue_columns).unionByName(
        known.where(repeated).select(*issue_columns).unionByName(bad).distinct())


def missing_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns only one side has."""
    rows = [(c, "missing_in_right") for c in left.columns if c not in right.columns]
    rows += [(c, "missing_in_left") for c in right.columns if c not in left.columns]
    return left.sparkSession.createDataFrame(rows, "column_name string, issue string")
