"""The row before each row, whatever the size of a group.

A window over a key puts all of the key's rows into one task. Here rows are dealt by ranges of key and order,
so a key of half of all rows lies in as many tasks as its share asks for; each range is read in order, and
only the last row of a range is handed on to the next. What is handed on is one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.session import stored


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                  ranges: int | None = None) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the row before it of the same key, NULL for a key's first row.

    NULL keys are one key; NULLs come first in order. Rows equal in keys and order stay in one range, so fold
    exact repeats first, and end ``order`` with the columns that tell rows apart. ``ranges``: how many
    (default: the session's shuffle partitions); boundaries come from Spark's sample of the rows, which only
    moves work, never results. The dealt rows are stored: both readings below see the same ranges.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
             .withColumn("_range", F.spark_partition_id()))
    columns = rows.columns
    at = [columns.index(k) for k in keys]
    place, kind = columns.index(value), rows.schema[value].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = last if last is not None else batch.slice(0, 1)
            before = [pa.concat_arrays([h, c.slice(0, batch.num_rows - 1)]) for h, c in zip(head.columns, batch.columns)]
            same = pa.array([True] * batch.num_rows)
            for i in at:
                now, then = batch.column(i), before[i]
                equal = pc.or_(pc.fill_null(pc.equal(now, then), False), pc.and_(pc.is_null(now), pc.is_null(then)))
                same = pc.and_(same, equal)
            first = pa.array([last is None] + [False] * (batch.num_rows - 1))
            previous = pc.if_else(pc.and_(same, pc.invert(first)), before[place], pa.scalar(None, before[place].type))
            last = batch.slice(batch.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, previous, first], names=[*columns, "_range", out, "_first"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField(out, kind),
                           T.StructField("_first", T.BooleanType())])
    walked = stored(dealt.mapInArrow(walk, schema), "ranges")
    # The last row of each range: the largest in key and order, one row a range.
    tail = walked.groupBy("_range").agg(F.max(F.struct(*dict.fromkeys([*keys, *order, value]))).alias("_tail"))
    handed = F.broadcast(tail.select(
        F.lead("_range").over(Window.orderBy("_range")).alias("_to"), "_tail"))  # empty ranges have no row
    met = walked.join(handed, walked["_first"] & (walked["_range"] == handed["_to"]), "left")
    same = F.col("_to").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_tail.{k}"))
    return met.select(*columns, F.when(F.col("_first"), F.when(same, F.col(f"_tail.{value}"))).otherwise(F.col(out)).alias(out))
