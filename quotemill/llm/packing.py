"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous: documents are ordered by length and gaps by size; in one superstep all documents of
the next length meet all gaps at once. A sweep upwards from the successor gap (the smallest that holds the
length) hands gaps to documents; documents that want the same gap are told apart by their rank among
equals; gaps shrink and the next superstep begins. What finds no gap opens new sequences.

Lengths and gap sizes are whole numbers up to ``max_tokens``, so documents of a length and gaps of a size
are *runs*: the sweeps move runs (at most ``max_tokens`` lengths, however many documents) and their outcome
is a plan of a few numbers per run. Tokenising, ranking and placing, all that touches rows, is
distributed; ranks are hash parts plus offsets, so a length shared by a third of all rows is no hot task.

Cases: NULL or empty text has only its end id; only documents longer than a sequence are cut, into whole
sequences and a rest; repeated rows are placed each; an empty table gives no rows; extra columns are
ignored. Numbers of sequences have no meaning beyond identity.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm.common import numbered, stored

MAX_TOKENS, END_ID = 2048, 0
#: Words kept with their ids by a worker; beyond that it starts anew (memory only, never results).
CACHE_WORDS = 1_000_000

_SPLIT = re.compile(r"[ \t\r\n]+")
_STOPS = re.compile(r"(?<=[a-z])([.,])(?=[ \t\r\n])")
_PLAIN = re.compile("[ɐ-\U0010ffff]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of whole texts from ids of words.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in order;
    each worker keeps those of the words it has seen. It also lower-cases, so texts without letters
    beyond Latin Extended-B and without control strings are lowered first, and a stop behind a letter is
    set off as a word of its own. Words of Latin letters alone go straight to the model.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and max(word) < "ɐ":
            spelled = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            ids = [t.id for t in self.model.tokenize(spelled)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not _PLAIN.search(text):
            text = _STOPS.sub(r" \1", text.lower())
        known, out = self.known, []
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in _SPLIT.split(text):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary): documents cut only where they must be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            out: list[tuple] = []
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(said or "") + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names=names[:n])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                           + (", ids binary" if with_ids else ""))


def sweep(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """The plan: (length, first rank, first sequence, documents per sequence, offset) per run placed.

    Documents of a length with ranks from ``first rank`` on fill sequences from ``first sequence`` on, that
    many each, behind ``offset`` ids. ``counts``: number of documents by length, at most ``max_tokens``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs (first sequence, how many)
    sizes: list[int] = []
    plan, opened = [], 0

    def leave(size: int, first: int, many: int) -> None:
        if size > 0 and many > 0:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:  # no gap holds this length: new sequences for all that is left of it
                gap, first = max_tokens, opened
                many = -(-left // (max_tokens // length))
                opened += many
            each = min(gap // length, left)
            full = min(many, left // each)
            plan.append((length, rank, first, each, max_tokens - gap))
            leave(gap - each * length, first, full)
            leave(gap, first + full, many - full)
            rank, left = rank + full * each, left - full * each
    return plan


def place(parts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``parts`` (stored; doc_id, piece, length, ids_crc32 ..) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan = np.array(sweep(counts, max_tokens), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    starts = plan[:, 0] * (1 << 40) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, k = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = plan[np.searchsorted(starts, size * (1 << 40) + k, side="right") - 1]
        behind = k - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + behind // row[:, 3],
                             "offset": row[:, 4] + behind % row[:, 3] * size})

    ranked = numbered(parts, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    return (ranked.withColumn("_at", placed("length", "_rank"))
            .select(*parts.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")))


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(stored(pieces(docs, tokenizer, max_tokens, with_ids, doc_id, text), "pieces"), max_tokens)
