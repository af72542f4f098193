"""Days held per key as bitmaps: 64 calendar days a word, one bit a day.

A row ``keys, word, bits`` stands for up to 64 days (about 45 trading days), so maps are a small part of the
rows they come from. Words are joined with ``bit_or``, which combines on the map side, ignores repeats and
merges the maps of several loads. A hot key costs one row per word and input partition, however often its
days repeat. Rows without a key or a date are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _all_bits() -> Column:
    return F.lit(-1).cast("bigint")


def day_maps(rows: DataFrame, keys: Sequence[str] = ("code",), date_col: str = "day") -> DataFrame:
    """``keys, word, bits`` of the days each key has a row on."""
    number = F.unix_date(F.col(date_col).cast("date"))
    bit = _shift("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD)))
    placed = rows.select(*keys, F.shiftright(number, 6).alias("word"), bit.alias("bits"))
    # spelled out as a join would add them, so that a join's side and a plain aggregate share one shuffle
    for c in (*keys, "word"):
        placed = placed.filter(F.col(c).isNotNull())
    return placed.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def maps_of(df: DataFrame) -> DataFrame:
    """Maps as they are; anything else is taken for rows of ``code, day``."""
    return df if {"word", "bits"} <= set(df.columns) else day_maps(df)


def merged(*maps: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """The maps of several loads as one."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def with_open_words(df: DataFrame, calendar: DataFrame, out: str = "_words") -> DataFrame:
    """Adds the calendar as one array of ``word, bits``: the DATE domain bounds it (571 words a century).

    ``calendar`` has a row per trading day, or is a frame of maps whose days are all taken as trading days.
    """
    words = calendar if "bits" in calendar.columns else day_maps(calendar, ())
    one = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return df.withColumn(out, one.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))).scalar())


def span_mask(word: Column, first: Column, last: Column) -> Column:
    """The bits of a word whose days lie in ``[first, last]``; none where an end is unknown."""
    lo = F.greatest(F.unix_date(first) - word * WORD, F.lit(0))
    hi = F.least(F.unix_date(last) - word * WORD, F.lit(WORD - 1))
    mask = _shift("shiftleft", _all_bits(), lo).bitwiseAND(
        _shift("shiftrightunsigned", _all_bits(), F.lit(WORD - 1) - hi))
    known = first.isNotNull() & last.isNotNull()
    return F.when(known & (lo < WORD) & (hi >= 0), mask).otherwise(F.lit(0).cast("bigint"))


def newest_day(words: Column, upto: Column) -> Column:
    """The newest day of the array ``words`` not after ``upto``; NULL without one."""
    def top(w: Column) -> Column:
        bits = w["bits"].bitwiseAND(span_mask(w["word"], F.lit("0001-01-01").cast("date"), upto))
        place = F.length(F.bin(bits)) - 1
        return F.when(bits != 0, F.date_from_unix_date(w["word"] * WORD + place))

    return F.array_max(F.transform(words, top))


def counted_calendar(calendar: DataFrame, as_of: Column) -> Column:
    """The calendar as one value, for a scalar: its first word, per word the bits and the days before it, and the newest
    day not after ``as_of``.

    Words without days are laid in, so that a day finds its word by place. Some 571 cells a century; ``calendar`` as in
    ``with_open_words``.
    """
    words = calendar if "bits" in calendar.columns else day_maps(calendar, ())
    one = words.filter("word IS NOT NULL").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    by_word = Window.orderBy("word")
    counted = one.select(
        F.col("word").alias("_own"), "bits", F.lead("word").over(by_word).alias("_next"),
        F.coalesce(F.sum(F.bit_count("bits")).over(by_word.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # laid in from each word up to the next: a join of the words with themselves fails in Spark's PruneFilters inside a scalar
    spine = counted.select("*", F.explode(F.sequence("_own", F.coalesce(F.col("_next") - 1, F.col("_own")))).alias("word"))
    own = F.col("word") == F.col("_own")
    cells = spine.select("word", F.when(own, F.col("bits")).otherwise(F.lit(0).cast("bigint")).alias("bits"),
                         (F.col("before") + F.when(own, 0).otherwise(F.bit_count("bits"))).alias("before"))
    cell = F.struct("word", "bits", "before")
    packed = cells.agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return packed.select(F.struct(F.get("cells", F.lit(0))["word"].alias("first"), F.size("cells").alias("n"), "cells",
                                  newest_day(F.col("cells"), as_of).alias("newest"))).scalar()


def calendar_days_in(calendar: Column, first: Column, last: Column) -> Column:
    """How many days of a ``counted_calendar`` lie in ``[first, last]``: two look-ups, however long the span.

    ``calendar``, ``first`` and ``last`` should be plain columns: each is named several times.
    """
    def upto(number: Column) -> Column:
        word = F.shiftright(number, 6)
        cell = F.get(calendar["cells"], (word - calendar["first"]).cast("int"))
        held = F.bit_count(cell["bits"].bitwiseAND(_shift("shiftrightunsigned", _all_bits(), F.lit(WORD - 1) - F.pmod(number, F.lit(WORD)))))
        top = F.get(calendar["cells"], calendar["n"] - 1)
        return F.when(word < calendar["first"], 0).when(word > top["word"], top["before"] + F.bit_count(top["bits"])) \
            .otherwise(cell["before"] + held)

    some = (calendar["n"] > 0) & (first <= last)
    return F.when(some, upto(F.unix_date(last)) - upto(F.unix_date(first) - 1)).otherwise(0).cast("bigint")


def days_of(maps: DataFrame, bits: str = "bits", out: str = "day") -> DataFrame:
    """One row per set bit: the other columns and the day."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(bits), i) == 1)
    rest = [c for c in maps.columns if c not in ("word", bits)]
    return maps.select(*rest, "word", F.explode(places).alias("_place")).select(
        *rest, F.date_from_unix_date((F.col("word") * WORD + F.col("_place")).cast("int")).alias(out))


def held_between(spans: DataFrame, maps: DataFrame, first: str, last: str, key: str = "code",
                 out: str = "actual_days") -> DataFrame:
    """``spans`` with the number of days its key has in ``[first, last]``; equal spans become one row."""
    inside = F.bit_count(F.col("bits").bitwiseAND(span_mask(F.col("word"), F.col(first), F.col(last))))
    return spans.join(maps, key, "left").groupBy(*spans.columns).agg(
        F.coalesce(F.sum(inside), F.lit(0)).cast("bigint").alias(out))


def missing(expected: DataFrame, maps: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """``keys, day`` of the days ``expected`` (maps as well) has and ``maps`` lacks. Only those are opened."""
    held = maps.withColumnRenamed("bits", "_held")
    gone = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("bigint"))))
    left = expected.join(held, [*keys, "word"], "left").select(*keys, "word", gone.alias("bits"))
    return days_of(left.filter("bits <> 0"))
