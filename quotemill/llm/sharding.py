"""Shards by jump consistent hashing: a stable key and the number of shards decide, no ring table.

Appending a shard moves only the rows that the new shard takes (about one in ``shards + 1``).

Cases: a NULL key counts as one more key value; NULL text has no bytes (size 1, checksum 0); equal keys
share a shard, whatever the rows hold; repeated rows each get a slot; an empty table gives no rows; extra
columns are dropped (the result is keyed by ``doc_id``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import numbered, stored

#: Multiplier of the 64-bit linear congruential step in the published jump hash. Fixed value.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last jump of its own random sequence that stays below ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, to = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = to[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)))).astype(np.int64)
            live = live[to[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column of any type, from its 64-bit hash."""
    @F.pandas_udf("int")
    def placed(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return placed(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``key``), shard, slot (gapless per shard), grown_shard.

    ``grown_shard`` is the shard if one more were appended: the same one, or the new one.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
                       F.crc32(content.cast("binary")).alias("text_crc32"))
    placed = slim.select("*", shard_of(F.col("doc_id"), shards).alias("shard"),
                         shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    slots = numbered(stored(placed, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
