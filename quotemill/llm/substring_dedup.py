"""Removal of repeated word windows: rolling Rabin-Karp hashes, counted in Spark.

A window is ``width`` consecutive words of one document. Every window of every document gets a rolling hash
(two polynomials modulo 2^64 over the words' XXH64; 64 bits of the first and 16 of the second tell windows
apart). A word goes if it is covered by a window that also starts in a document with a smaller doc_id;
windows are judged on the input. Removed windows that overlap or touch merge into maximal intervals.

1. Arrow tasks hash the windows and count them within a piece of ``WORDS_AT_ONCE`` words: of a window that
   several documents of the piece hold only the smallest doc_id's copy travels on, the others are decided.
   A passage that a third of all documents holds thus costs one entry per piece, not one per document;
   decided entries only pass through. What is dealt by hash are lists, one per piece and bucket of hashes.
2. The lists of a bucket, ``BUCKET_BYTES`` of text on average whatever the corpus, are merged; each window's
   smallest doc_id follows.
3. The hashes to remove, at most as many as a document has words, are joined to their documents, whose
   words are hashed once more.

Cases: NULL or empty text has no words; documents shorter than a window are left whole; repeats inside one
document stay, and so do rows that agree in doc_id (none is smaller); rows without doc_id are left whole and
remove nothing; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import mixed64, salts

WIDTH = 13
#: Words hashed and counted together; a longer document is a piece of its own. A task holds about 100 bytes a word.
WORDS_AT_ONCE = 500_000
#: Bytes of text whose windows share a bucket, on average. A task holds about ten times that. A list has
#: WORDS_AT_ONCE * BUCKET_BYTES / (bytes of all texts) windows: raise both with the workers' memory for corpora
#: beyond a few TB, so that lists stay longer than some dozens.
BUCKET_BYTES = 8_000_000
#: Longer words are hashed by XXH64: polynomials modulo 2^64 tell short strings apart, not all long ones.
LONG_WORD = 128
#: Odd bases of the polynomials over bytes and over words.
BYTE_BASE, BASES = 0xA0761D6478BD642F, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTER = mixed64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_deflate, _inflate = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base, base^2 .. base^n modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.full(max(n, 1 << 16), base, np.uint64).cumprod()
    return _powers[base][:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values over powers of the base, from an empty one."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(pow(base, -1, 1 << 64), len(values)))])


def words_of(text: str | None) -> list[bytes]:
    """Words are runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_values(text: str | None) -> np.ndarray:
    """A hash of every word, from running sums over the text's bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    letter = np.zeros(len(raw) + 2, np.int8)
    letter[1:-1] = ~_SPACE[raw]
    edges = np.nonzero(np.diff(letter))[0]
    starts, ends = edges[::2], edges[1::2]
    sums = _sums(_LETTER[raw], BYTE_BASE)
    out = mixed64((sums[ends] - sums[starts]) * _power(BYTE_BASE, len(raw) + 1)[starts])
    for i in np.nonzero(ends - starts > LONG_WORD)[0].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    return out


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial hash of every ``width`` values in a row, each from two running sums."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    sums = _sums(values, base)
    return (sums[width:] - sums[:-width]) * _power(base, len(values) - width + 1)


def window_hashes(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of the first and the upper 16 bits of the second polynomial, per window."""
    first, second = (mixed64(rolling(values, width, b)) for b in BASES)
    return first, (second >> np.uint64(48)).astype(np.uint16)


def _runs(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where a new window begins in rows sorted by hash."""
    starts = np.ones(len(h), bool)
    starts[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    return starts


def packed(h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> bytes:
    """Windows in order of their hashes as differences, byte by byte of all, compressed: about half of what rows take."""
    steps = np.diff(h, prepend=np.uint64(0)).astype(np.uint64)
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(h), -1).T.tobytes() for x in (steps, s, doc)]
    return _deflate.compress(b"".join(planes))


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(_inflate.decompress(data), np.uint8)
    h, s, doc = (np.ascontiguousarray(x.reshape(-1, n).T).view(kind).ravel()
                 for x, kind in zip(np.split(flat, [8 * n, 10 * n]), (np.uint64, np.uint16, np.int64)))
    return np.cumsum(h, dtype=np.uint64), s, doc


def _counted(docs: list[tuple[int, np.ndarray]], width: int, buckets: int) -> pa.RecordBatch:
    """The windows of a piece, a row per bucket of hashes: each window once, for its smallest doc_id; and the decided ones."""
    docs.sort(key=lambda d: d[0])
    lengths = np.array([len(v) for _, v in docs])
    ends = np.cumsum(lengths)
    first, second = window_hashes(np.concatenate([v for _, v in docs]), width)
    owner = np.repeat(np.arange(len(docs)), lengths)
    inside = np.nonzero(np.arange(len(first)) + width <= ends[owner[:len(first)]])[0]
    order = inside[np.argsort(first[inside], kind="stable")]
    h, s, doc = first[order], second[order], np.array([d for d, _ in docs], np.int64)[owner[order]]
    starts = _runs(h, s)
    least = doc[np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))]
    again = np.zeros(len(h), bool)
    again[1:] = ~starts[1:] & (doc[1:] == doc[:-1])
    rows = []
    one = np.nonzero(starts)[0]
    bucket = ((h[one] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(one)]])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        x = one[lo:hi]
        rows.append((int(bucket[lo]), False, len(x), packed(h[x], s[x], doc[x])))
    x = np.nonzero((doc > least) & ~again)[0]
    if len(x):  # nothing is to be found out about these: any bucket will do
        rows.append((int(bucket[len(x) % len(bucket)]), True, len(x), packed(h[x], s[x], doc[x])))
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))],
        names=["bucket", "decided", "n", "data"])


def windows(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
            piece_words: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """bucket, decided, n, data: the windows counted piece by piece, as lists (see ``packed``) per bucket of hashes."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = 1 + size // (bucket_bytes or BUCKET_BYTES)
    most = piece_words or WORDS_AT_ONCE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = [], 0
        for batch in batches:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = word_values(said.as_py())
                if len(values) < width:
                    continue
                if piece and held + len(values) > most:
                    yield _counted(piece, width, buckets)
                    piece, held = [], 0
                piece.append((doc, values))
                held += len(values)
        if piece:
            yield _counted(piece, width, buckets)

    slim = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    dealt = slim.mapInArrow(count, "bucket int, decided boolean, n int, data binary")
    return dealt.repartition(max(buckets, salts(docs)), "bucket")


def _later(lists: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of a bucket's windows that a smaller doc_id holds as well."""
    h, s, doc = (np.concatenate(x) for x in zip(*(unpacked(data, n) for n, data in lists)))
    order = np.argsort(h, kind="stable")
    starts = _runs(h[order], s[order])
    if starts.sum() > 1 + np.count_nonzero(np.diff(h[order])):  # one hash, several windows
        order = np.lexsort((s, h))
        starts = _runs(h[order], s[order])
    h, doc = h[order], doc[order]
    at = np.nonzero(starts)[0]
    least = np.repeat(np.minimum.reduceat(doc, at), np.diff(at, append=len(doc)))
    return doc[doc > least], h[doc > least]


def repeated_windows(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """doc, hash: windows of a document that also start in a document with a smaller doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h.view(np.int64))], names=["doc", "hash"])

        lists, now = [], None
        for batch in batches:
            for bucket, decided, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "decided", "n", "data"))):
                if decided:
                    h, _, doc = unpacked(data, n)
                    yield found(doc, h)
                    continue
                if bucket != now and lists:
                    yield found(*_later(lists))
                    lists = []
                now = bucket
                lists.append((n, data))
        if lists:
            yield found(*_later(lists))

    return windows(docs, width, doc_id, text, **sizes).sortWithinPartitions("bucket").mapInArrow(run, "doc long, hash long")


def intervals(covered: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals (start, end exclusive) of the words that windows starting at ``covered`` hold."""
    if not len(covered):
        return []
    breaks = np.nonzero(np.diff(covered) > width)[0]
    starts = covered[np.concatenate([[0], breaks + 1])]
    ends = covered[np.concatenate([breaks, [len(covered) - 1]])] + width
    return list(zip(starts.tolist(), ends.tolist()))


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
                   with_text: bool = True, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words), kept_sha256 and, if asked for, kept (the words left).

    ``sizes``: ``piece_words`` and ``bucket_bytes`` (WORDS_AT_ONCE and BUCKET_BYTES by default).
    """
    gone = (repeated_windows(docs, width, doc_id, text, **sizes).groupBy("doc").agg(F.collect_list("hash").alias("hashes")))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = slim.join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "hashes")
    kinds = [pa.int64(), pa.int64(), pa.int64(),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept"][:5 + with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            hashes = batch.column(2)
            for i, (doc, said) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = words_of(said.as_py())
                spans = []
                if hashes[i].is_valid:
                    first, _ = window_hashes(word_values(said.as_py()), width)
                    spans = intervals(np.nonzero(np.isin(first.view(np.int64), hashes[i].values.to_numpy()))[0], width)
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept = b" ".join(kept + words[at:] if spans else words)
                out.append((doc, len(words), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans],
                            hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:len(names)], kinds)], names=names)

    schema = ("doc_id long, n_words long, n_removed long, removed array<struct<start long, end long>>, kept_sha256 string"
              + (", kept string" if with_text else ""))
    return joined.mapInArrow(run, schema)
