"""Alignment of two tokenizers' tokens by coalescing their byte intervals.

A is a byte-level BPE over a space and the text, B a piece model that adds that space itself, so both cut the
same bytes. All tokens of A and B are put in order by start (a lexsort), the running maximum of their ends
is taken, and a group ends where a start reaches it: overlapping tokens of one group expand into each other,
and groups are cut exactly where tokens of both end together. The pair of tokens that end there is a link.

How often an id pair is linked is counted over the corpus in Spark: each document hands over its distinct
pairs with their number, sums are pre-aggregated, and the counts come back by a lookup join. Pairs that
``OFTEN``-ths of all rows hold are at most ``OFTEN`` and are broadcast; the others are shuffled, and none
of them is a hot key. What is learned per id of B is bounded by its vocabulary.

Tokens of a text are those of its chunks (a chunk is a run without white space with the spaces before it):
neither the splitting rules of A nor any piece of B crosses a chunk's border, which is checked against B's
pieces when the model is loaded. A worker keeps the ids of the chunks that it has seen. Texts with
characters beyond Latin, or with control characters, go through A's own tokenizer whole.

Cases: texts that are NULL, empty or that the tokens of A or B don't spell exactly have no tokens (zeros and an
empty ``groups_sha256``); control strings inside texts are plain text; repeated rows count each; rows
without doc_id are kept; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm.common import byte_letters, looked_up, stored

#: Chunks kept with their ids by a worker, and the longest that are kept (memory only, never results).
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 40
#: Pairs held by at least one in so many rows are broadcast.
OFTEN = 100_000
#: Tokens aligned together.
TOKENS_AT_ONCE = 1_000_000

_CHUNK_A = re.compile(r" ?\S+|\s+(?!\S)|\s")
_CHUNK_B = re.compile(r" *[^ \n]+| +|\n")
#: Characters whose classes every library agrees on.
_NOT_PLAIN = re.compile("[^\t\n -~¡-ɏ‐-‧]")
_SPACE = "▁"


class ByteLevel:
    """Tokenizer A: ids of a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(letters[c] for c in token)
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)
        self.known: dict[str, np.ndarray | None] = {}

    def _ids(self, text: str) -> bytes | None:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        if b"".join([self.spelled[i] for i in ids]) != text.encode():
            return None
        return np.array(ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray | None:
        """Ids, or None if they don't spell a space and the text."""
        whole = " " + text
        if _NOT_PLAIN.search(whole):
            ids = self._ids(whole)
            return None if ids is None else np.frombuffer(ids, np.uint32)
        return _joined(self.known, _CHUNK_A.findall(whole), self._ids)


class Pieces:
    """Tokenizer B: ids of the text, whose first piece starts with a space of its own."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.spelled.append(bytes([int(byte[1], 16)]) if byte and self.model.is_byte(i)
                                else piece.replace(_SPACE, " ").encode())
            # a piece with white space behind its first letter could cross chunks
            if "\n" in piece or _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {i} crosses white space: texts cannot be cut there")
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)
        self.known: dict[str, bytes | None] = {}
        self.lead = self.model.encode("\n")

    def _ids(self, chunk: str) -> bytes | None:
        if chunk[0] == " ":
            ids = self.model.encode(chunk[1:]) if len(chunk) > 1 else self.model.encode("\n")[:1]
        else:  # behind a line's end, where no space is added
            ids = self.model.encode("\n" + chunk)[len(self.lead):] if chunk != "\n" else self.lead[1:]
        if b"".join([self.spelled[i] for i in ids]) != chunk.encode():
            return None
        return np.array(ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray | None:
        """Ids, or None if they don't spell a space and the text."""
        return _joined(self.known, _CHUNK_B.findall(" " + text), self._ids)


def _joined(known: dict, chunks: list[str], ids_of) -> np.ndarray | None:
    out = []
    for chunk in chunks:
        try:
            ids = known[chunk]
        except KeyError:
            ids = ids_of(chunk)
            if len(chunk) <= CACHE_CHARS:
                if len(known) >= CACHE_CHUNKS:
                    known.clear()
                known[chunk] = ids
        if ids is None:
            return None
        out.append(ids)
    return np.frombuffer(b"".join(out), np.uint32)


@dataclass
class Aligned:
    """Tokens of several texts in order (by group, A before B) and the links of their groups."""

    ids: np.ndarray
    is_b: np.ndarray
    new_group: np.ndarray
    text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_text: np.ndarray


def aligned(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """Coalesces the byte intervals of each text's A and B tokens; texts lie one behind the other."""
    a_ids, b_ids = np.concatenate(a), np.concatenate(b)
    a_ends, b_ends = np.cumsum(a_lengths[a_ids]), np.cumsum(b_lengths[b_ids])
    ids, ends = np.concatenate([a_ids, b_ids]), np.concatenate([a_ends, b_ends])
    starts = ends - np.concatenate([a_lengths[a_ids], b_lengths[b_ids]])
    is_b = np.repeat([False, True], [len(a_ids), len(b_ids)])
    order = np.lexsort((is_b, starts))
    reach = np.maximum.accumulate(ends[order])
    cut = np.ones(len(order), bool)
    cut[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(cut) - 1
    # within a group A's tokens, then B's, each in order: both lists are in order of groups already
    n_groups = int(cut.sum())
    a_group, b_group = group[:len(a_ids)], group[len(a_ids):]
    a_count, b_count = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    place = np.empty(len(ids), np.int64)
    place[:len(a_ids)] = np.arange(len(a_ids)) + (np.cumsum(b_count) - b_count)[a_group]
    place[len(a_ids):] = np.arange(len(b_ids)) + np.cumsum(a_count)[b_group]
    text_of = np.concatenate([np.repeat(np.arange(len(a)), [len(x) for x in a]),
                              np.repeat(np.arange(len(b)), [len(x) for x in b])])
    out = Aligned(np.empty_like(ids), np.empty_like(is_b), np.zeros(len(ids), bool), np.empty_like(text_of),
                  a_ids[np.cumsum(a_count) - 1], b_ids[np.cumsum(b_count) - 1], None)
    out.ids[place], out.is_b[place], out.text[place] = ids, is_b, text_of
    out.new_group[np.cumsum(a_count + b_count) - (a_count + b_count)] = True
    out.link_text = text_of[np.cumsum(a_count) - 1]
    return out


_LOADED: dict[tuple[str, str], tuple] = {}


def loaded(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, list[bytes]]:
    """The tokenizers of a worker, and the decimal of every id behind each separator."""
    if (a_path, b_path) not in _LOADED:
        a, b = ByteLevel(a_path), Pieces(b_path)
        many = max(len(a.spelled), len(b.spelled))
        said = [sep + str(i).encode() for sep in (b",", b";", b"|") for i in range(many)]
        _LOADED[a_path, b_path] = a, b, np.array(said, dtype=object)
    return _LOADED[a_path, b_path]


def _rows(docs: list, texts: list[str | None], tools: tuple) -> list[tuple]:
    """(doc, n_a, n_b, n_groups, groups_sha256, pairs, times) of each text."""
    one, other, said = tools
    many = len(said) // 3
    a, b, who = [], [], []
    for i, text in enumerate(texts):
        if text and (x := one.encode(text)) is not None and (y := other.encode(text)) is not None:
            a.append(x)
            b.append(y)
            who.append(i)
    empty = np.zeros(0, np.int64)
    out = [(doc, 0, 0, 0, "", empty, empty) for doc in docs]
    if not who:
        return out
    x = aligned(a, b, one.lengths, other.lengths)
    first_b = x.is_b.copy()
    first_b[1:] &= ~x.is_b[:-1]
    parts = said[x.ids + many * np.where(x.new_group, 1, np.where(first_b, 2, 0))]
    pairs = x.link_a.astype(np.int64) << 32 | x.link_b.astype(np.int64)
    ends, link_ends = (np.searchsorted(t, np.arange(len(who) + 1)) for t in (x.text, x.link_text))
    for k, i in enumerate(who):
        spelled = b"".join(parts[ends[k]:ends[k + 1]].tolist())
        own, times = np.unique(pairs[link_ends[k]:link_ends[k + 1]], return_counts=True)
        out[i] = (docs[i], len(a[k]), len(b[k]), int(link_ends[k + 1] - link_ends[k]),
                  hashlib.sha256(spelled[1:]).hexdigest(), own, times)
    return out


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (distinct id pairs a << 32 | b and how often each is linked)."""
    pair = pa.struct([("pair", pa.int64()), ("times", pa.int64())])
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, n_a, n_b, n_groups, sha, own, times = zip(*rows)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(np.concatenate(own), pa.int64()), pa.array(np.concatenate(times), pa.int64())], fields=list(pair)))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (doc, n_a, n_b, n_groups)],
                                           pa.array(sha, pa.string()), links], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(a_path, b_path)
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                said = said.as_py()
                if ids and held + len(said or "") > TOKENS_AT_ONCE:
                    yield batch_of(_rows(ids, texts, tools))
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(said)
                held += len(said or "")
            if ids:
                yield batch_of(_rows(ids, texts, tools))

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                "links array<struct<pair long, times long>>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (links that hold it in all texts), rows (texts that do), best (no pair of its B id has more)."""
    counts = found.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", "rows", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                    often: int = OFTEN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    found = stored(align(docs, a_path, b_path, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(found), "pairs")
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    held = found.select("row", F.inline("links"))
    known = looked_up(held, counts.drop("rows"), "pair", counts.where(F.col("rows") * often >= rows))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    joined = found.drop("links").join(sums, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                         *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
