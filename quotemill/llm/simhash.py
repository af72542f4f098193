"""SimHash near-duplicates: fingerprints, then links by a generalised pigeonhole search.

Fingerprint: ASCII-lowered words, w-word shingles, XXH64 (seed 42) of each; a bit is set if more than half
of the hashes set it. Texts are independent of each other, so this is one pass of Arrow batches.

Search over the *distinct* fingerprints: the 64 bits are grouped into m partitions, correlated bits
together (correlation over all fingerprints), and partition i gets a threshold T_i >= -1 (-1: not
probed). If the T_i add up to ``distance - m + 1``, two fingerprints within ``distance`` must differ by at
most T_i bits in some partition i. A dynamic programme picks the T_i with the fewest estimated keys and
candidates, from the pairs that share a partition's value, counted over all fingerprints; m itself is
chosen the same way. Each fingerprint then owns its value in partition i and visits the values within T_i.

A value shared by many fingerprints is cut into parts of at most ``PART`` and its pairs of parts are
compared in separate rows, so no list grows with the input. What leaves a comparison is a spanning forest
of the links found, never all pairs of a group; connected groups are the same.

Cases: NULL text is empty; without words the fingerprint is zero and linked like any other; fewer words
than the shingle length: the whole sequence is one shingle; equal texts or repeated rows share a
fingerprint and thereby a group; rows without doc_id are kept with ``component_id`` of their group;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import connected, files_for, stored, text_hashes, without_rows

BITS, SEED = 64, 42
#: Fingerprints compared at once; larger groups are cut into pairs of such parts.
PART = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; repeated shingles count as often as they occur."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bits of a bounded piece at a time
        piece = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text",
                      hashes: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); with h1 and h2 of the text, if asked for."""
    names = ["doc_id", "h1", "h2"] if hashes else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found.view(np.int64))],
                                             names=[*names, "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *(text_hashes(F.col(text)) if hashes else []),
                       F.col(text).alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def co_occurrence(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how often two bits are both set.

    Each task sums its own table; tables are added per cell before 4,096 numbers reach the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 20):
                total += bits[at:at + (1 << 20)].T @ bits[at:at + (1 << 20)]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().astype(np.int64)])], names=["cells"])

    cells = (prints.select("fp").mapInArrow(run, "cells array<long>").select(F.posexplode("cells"))
             .groupBy("pos").agg(F.sum("col").alias("n")).collect())
    table = np.zeros(BITS * BITS)
    for pos, n in cells:
        table[pos] = n
    return prints.count(), table.reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, the most correlated ones together."""
    share = both.diagonal() / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    covariance = both / max(n, 1) - np.outer(share, share)
    tie = np.abs(covariance) / np.maximum(np.outer(spread, spread), 1e-12)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        first = max(left, key=lambda b: (sum(tie[b][o] for o in left if o != b), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nearest = max(left, key=lambda b: (sum(tie[b][g] for g in group), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def partition_value(bits: list[int]):
    """The fingerprint's bits of one partition, as a long with all other bits zero."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def allocate(widths: list[int], same: list[float], n: int, distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds: keys written plus candidates compared.

    ``same[i]`` is the number of pairs that agree in partition i; within t bits it is taken to grow with
    the number of values within t.
    """
    m = len(widths)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, pairs in zip(widths, same):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                ball = sum(comb(w, d) for d in range(t + 1))
                # a key costs about as much as sixteen comparisons
                price = 0.0 if t < 0 else 16.0 * n * (ball + (t > 0)) + pairs * ball
                if used + t + 1 not in step or cost + price < step[used + t + 1][0]:
                    step[used + t + 1] = (cost + price, [*chosen, t])
        best = step
    return best[distance + 1]  # sum of (T_i + 1) = distance - m + 1 + m


def plan(prints: DataFrame, distance: int, choices: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed, for the cheapest number of partitions."""
    n, both = co_occurrence(prints)
    layouts = {m: grouped_bits(n, both, m) for m in choices}
    tags = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), partition_value(bits).alias("v"))
                       for k, (_, _, bits) in enumerate(tags)])
    met = (prints.select(F.inline(values)).groupBy("k", "v").count()
           .groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")))
    pairs = {r["k"]: r["pairs"] for r in met.collect()}
    options = []
    for m, groups in layouts.items():
        same = [float(pairs.get(k, 0.0)) for k, (mm, _, _) in enumerate(tags) if mm == m]
        cost, chosen = allocate([len(g) for g in groups], same, n, distance)
        options.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _visited(bits: list[int], threshold: int):
    """Values within 1..threshold bits of a partition's own value."""
    masks = [0]
    for _ in range(threshold):
        masks = sorted({m ^ (1 << b) for m in masks for b in bits} | set(masks))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks if m]
    own = partition_value(bits)
    return F.transform(F.array(*[F.lit(s).cast("long") for s in signed]), lambda s: own.bitwiseXOR(s))


def spanning(members: np.ndarray, labels: np.ndarray, owners: np.ndarray, cut: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints of one key (or of one pair of its parts).

    ``members`` are distinct fingerprints, ``labels`` their nodes; at least one end of a pair owns the
    key. Rows before ``cut`` are compared with rows from ``cut`` on; ``cut`` 0: all with all.
    """
    n, out = len(members), []
    group = np.arange(n)
    for i in range(cut or n):
        j0 = cut or i + 1
        near = np.bitwise_count(members[j0:] ^ members[i]) <= distance
        if not owners[i]:
            near &= owners[j0:]
        near &= group[j0:] != group[i]
        for j in (np.nonzero(near)[0] + j0).tolist():
            if group[j] != group[i]:  # may have been joined just now
                out.append((int(labels[i]), int(labels[j])))
                group[group == group[j]] = group[i]
    return out


def links(prints: DataFrame, distance: int = 3, choices: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Edges (a, b) between nodes of fingerprints within ``distance`` bits, enough to connect all that are linked.

    ``prints``: fp (distinct), node. Every linked pair meets under some key; a key's pairs are reduced to a
    spanning forest.
    """
    probed = plan(prints, distance, choices)
    own = F.array(*[F.struct(F.lit(k).cast("int").alias("k"), partition_value(bits).alias("v"), F.lit(True).alias("own"))
                    for k, (bits, _) in enumerate(probed)])
    keys = prints.select("fp", "node", F.inline(own))
    wide = [(k, bits, t) for k, (bits, t) in enumerate(probed) if t > 0]
    if wide:
        def visit(k: int):  # one argument only: a second one would be taken for the element's index
            return lambda v: F.struct(F.lit(k).cast("int").alias("k"), v.alias("v"), F.lit(False).alias("own"))

        visits = F.concat(*[F.transform(_visited(bits, t), visit(k)) for k, bits, t in wide])
        keys = keys.unionByName(prints.select("fp", "node", F.inline(visits)))
    # parts: a key's rows fall into ceil(count / PART) parts by hash; every pair of parts is one list
    sizes = (keys.groupBy("k", "v").agg(F.count("*").alias("n"), F.bool_or("own").alias("owned"))
             .where("n > 1 AND owned").select("k", "v", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    met = keys.join(sizes, ["k", "v"]).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                         lambda q: F.struct(F.least("p", q).alias("lo"), F.greatest("p", q).alias("hi")))
    tiles = (met.select("fp", "node", "k", "v", "own", "p", F.inline(others))
             .groupBy("k", "v", "lo", "hi").agg(F.collect_list(F.struct("p", "fp", "node", "own")).alias("rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            lists = batch.column("rows")
            ends = lists.offsets.to_numpy()
            flat = lists.values
            p, fp, node, mine = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("p", "fp", "node", "own"))
            fp = fp.view(np.uint64)
            size = np.diff(ends)
            a, b = [], []
            two = np.nonzero(size == 2)[0]  # by far the most: a key that two fingerprints share
            x, y = ends[two], ends[two] + 1
            ok = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) & (mine[x] | mine[y])
            a.extend(node[x[ok]].tolist())
            b.extend(node[y[ok]].tolist())
            for i in np.nonzero(size > 2)[0].tolist():
                rows = slice(ends[i], ends[i + 1])
                order = np.argsort(p[rows], kind="stable")
                cut = int((p[rows] == lo[i]).sum()) if lo[i] != hi[i] else 0
                if lo[i] != hi[i] and not 0 < cut < len(order):
                    continue  # one of the two parts is empty
                for s, t in spanning(fp[rows][order], node[rows][order], mine[rows][order], cut, distance):
                    a.append(s)
                    b.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    rows = stored(with_fingerprints(docs, shingle, doc_id, text), "fingerprints")
    many = rows.count()
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "prints",
                    files_for(many))
    groups = connected(links(prints, distance), many)
    named = prints.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest doc_id (NULL last), among those the one with the smallest hash.

    Rows are told apart by doc_id and text, so another text under the same doc_id stays; of rows that agree in
    both, one does.
    """
    rows = stored(with_fingerprints(docs, shingle, doc_id, text, hashes=True), "fingerprints")
    many = rows.count()
    files = files_for(many)
    prints = stored(rows.select("fp", F.col("fp").alias("node")).distinct(), "prints", files)
    groups = connected(links(prints, distance), many)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    grouped = stored(rows.join(groups, F.col("fp") == F.col("node"), "left").select(
        F.coalesce("component", "fp").alias("group"), row.alias("row")).groupBy("group", "row").count(), "grouped", files)
    kept = grouped.groupBy("group").agg(F.min("row").alias("keep"))
    gone = grouped.join(kept, "group").where("row <> keep").select("row.doc_id", "row.h1", "row.h2")
    if not grouped.where("count > 1").isEmpty():
        hashed = docs.withColumns({f"_sh_{i}": h for i, h in enumerate(text_hashes(F.col(text)))})
        docs = hashed.dropDuplicates([doc_id, "_sh_0", "_sh_1"]).select(*docs.columns)
    return without_rows(docs, gone, doc_id, text)
