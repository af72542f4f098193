"""What several operators share: stored tables, gapless numbering, connected groups."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.session import stored

__all__ = ["stored", "files_for", "numbered", "connected", "salts", "workers_import", "looked_up", "mixed64", "byte_letters", "text_hashes",
           "without_rows"]

#: Rows of a helper table in one file: enough to keep tasks small, few enough files.
ROWS_PER_FILE = 250_000


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def mixed64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby values get unrelated ones, and no two the same."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def text_hashes(text: Column) -> list[Column]:
    """h1, h2: 128 bits that stand for a text beside its doc_id; NULL and empty texts differ."""
    return [F.xxhash64(F.lit(i), text, text.isNull()).alias(f"h{i}") for i in (1, 2)]


def without_rows(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows whose doc_id (NULL like any other) and text are not among doc_id, h1, h2 of ``gone``."""
    named = gone.select(F.col("doc_id").alias("_gone_id"), F.col("h1").alias("_gone_1"), F.col("h2").alias("_gone_2")).distinct()
    h1, h2 = text_hashes(docs[text])
    same = docs[doc_id].cast("long").eqNullSafe(named["_gone_id"]) & (h1 == named["_gone_1"]) & (h2 == named["_gone_2"])
    return docs.join(named, same, "left_anti")


def looked_up(left: DataFrame, right: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """Inner join to ``right``, where ``key`` is unique, without a hot key.

    ``often`` has the keys that many rows of ``left`` hold, a bounded number of them by its definition: their
    rows meet a broadcast, all others a shuffle.
    """
    often = F.broadcast(often.select(key))
    few = left.join(often, key, "left_anti").join(right, key)
    return left.join(F.broadcast(right.join(often, key, "left_semi")), key).unionByName(few)


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def salts(df: DataFrame) -> int:
    """Parts that a hot group is split into: as many as a shuffle has partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2.. inside each group, without gaps, whatever a group's size.

    A group is cut into hash parts; rows are numbered inside a part and the parts' sizes (groups x
    parts rows, never the rows themselves) give each part its first number. ``df`` is read twice, so
    it should be a stored table. Rows that agree in ``order`` are exchangeable.
    """
    n = salts(df)
    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = parted.groupBy(*group, "_part").count()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    local = parted.withColumn("_local", F.row_number().over(inside) - 1)
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (local.join(first, same)
            .withColumn(name, (F.col("_first") + F.col("_local")).cast("long"))
            .drop("_part", "_p", "_first", "_local", *[f"_g_{g}" for g in group]))


def connected(edges: DataFrame, about: int, most_rounds: int = 60) -> DataFrame:
    """Connected groups of the graph of long columns ``a``, ``b``: rows (node, component).

    ``component`` is the group's smallest node. Alternating star rounds: every node hands its larger
    (then its smaller) neighbours to its smallest one, so the depth of a tree falls with each pair of
    rounds. Each round is a grouped minimum (pre-aggregated, so a hub is no hot task) and a join, and
    is written to the shared folder. Nodes without an edge to another node do not appear. ``about`` is the
    size of the graph in rows, for the number of files.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "edges", files_for(about))
    mark = _mark(now)
    for _ in range(most_rounds):
        now = stored(_star(_star(now, larger=True), larger=False), "edges", files_for(about))
        last, mark = mark, _mark(now)
        if mark == last:
            heads = now.select(F.col("b").alias("node")).distinct()
            return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .unionByName(heads.select("node", F.col("node").alias("component"))))
    raise RuntimeError(f"groups not settled after {most_rounds} rounds")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round over edges (a > b): links to the smallest neighbour, each edge once, a > b."""
    if larger:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    moved = near.join(least, F.col("a") == F.col("n"))
    if larger:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the smallest node keeps its own edge to a larger hub
        out = out.unionByName(moved.where("m < a").select("a", F.col("m").alias("b")))
    else:
        out = (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))))
    out = out.where("a <> b")
    return out if larger else out.distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
