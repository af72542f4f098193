"""Language identification with a bidirectional gated recurrent network over bytes.

Both directions are GRUs with hard gates (clipped lines in place of sigmoid and tanh), trained in numpy by
backpropagation through time. Every byte position gets a distribution over the languages, from what
stands before and behind it in its stretch of ``WINDOW`` bytes; a document's probabilities are the means
over its letter positions, over the whole text.

The network is fitted on the driver to a bounded sample: ``per_language`` labelled documents of each
language, those with the smallest hash of doc_id, ``WINDOWS`` stretches of each, at hashed places. Which
rows may be learnt from is the caller's filter. A language is learnt from rows; doc_id and source are never
inputs. All else is done for every text, in Arrow batches, with bounded memory.

Cases: text that is NULL or has no letters is ``und`` with score 0; without any labelled row every text is
``und``; rows with NULL language are not learnt from; ties go to the first language in order; repeated rows
get the same answer; empty tables give no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNDETERMINED = "und"
WINDOW, WINDOWS, PER_LANGUAGE = 64, 12, 300
HIDDEN, STEPS, BATCH, RATE = 8, 420, 192, 0.02
#: Stretches labelled at once.
AT_ONCE = 2048


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing may be learnt from: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Direction:
    """One GRU: ``table`` holds the weights of each byte (gates z, r and the candidate), ``back`` the recurrent ones."""

    table: np.ndarray
    back: np.ndarray

    def run(self, x: np.ndarray, keep: bool = False):
        """States [T, B, H] for bytes [T, B]; with ``keep`` also what the backward pass needs."""
        t, b = x.shape
        h, out, kept = np.zeros((b, HIDDEN), np.float32), np.empty((t, b, HIDDEN), np.float32), []
        for i in range(t):
            u = h @ self.back
            a = self.table[x[i]]
            gates = np.clip(a[:, :2 * HIDDEN] + u[:, :2 * HIDDEN], -2, 2) * np.float32(0.25) + np.float32(0.5)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.clip(a[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:], -1, 1)
            if keep:
                kept.append((h, z, r, n, u[:, 2 * HIDDEN:]))
            h = n + z * (h - n)
            out[i] = h
        return out, kept

    def gradients(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of ``table`` and ``back``."""
        t, b = x.shape
        d_back, d_in = np.zeros_like(self.back), np.empty((t, b, 3 * HIDDEN), np.float32)
        d_h = np.zeros((b, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            before, z, r, n, u_n = kept[i]
            d_h = d_h + d_out[i]
            d_n = d_h * (1 - z) * (np.abs(n) < 1)
            d_z = d_h * (before - n) * np.float32(0.25) * ((z > 0) & (z < 1))
            d_r = d_n * u_n * np.float32(0.25) * ((r > 0) & (r < 1))
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_in[i] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_back += before.T @ d_u
            d_h = d_h * z + d_u @ self.back.T
        one_hot = np.zeros((256, t * b), np.float32)
        one_hot[x.ravel(), np.arange(t * b)] = 1
        return one_hot @ d_in.reshape(-1, 3 * HIDDEN), d_back


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.languages = languages
        self.ahead = Direction(draw(256, 3 * HIDDEN, by=0.3), draw(HIDDEN, 3 * HIDDEN, by=0.3))
        self.behind = Direction(draw(256, 3 * HIDDEN, by=0.3), draw(HIDDEN, 3 * HIDDEN, by=0.3))
        self.out, self.bias = draw(2 * HIDDEN, len(languages), by=0.3), np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.back, self.behind.table, self.behind.back, self.out, self.bias]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [T, B, languages] of every position of bytes [T, B]."""
        states = np.concatenate([self.ahead.run(x)[0], self.behind.run(x[::-1])[0][::-1]], axis=2)
        return _softmax(states.reshape(-1, 2 * HIDDEN) @ self.out + self.bias).reshape(*x.shape, -1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
        """Adam on the mean cross entropy of all letter positions; x [N, T] bytes, y [N] language numbers."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            pick = rng.integers(len(x), size=min(BATCH, len(x)))
            grads = self._gradients(np.ascontiguousarray(x[pick].T), y[pick])
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        t, b = x.shape
        ahead, kept_a = self.ahead.run(x, keep=True)
        behind, kept_b = self.behind.run(x[::-1], keep=True)
        states = np.concatenate([ahead, behind[::-1]], axis=2).reshape(-1, 2 * HIDDEN)
        d = _softmax(states @ self.out + self.bias)
        d[np.arange(t * b), np.tile(y, t)] -= 1
        counted = LETTER[x].reshape(-1, 1)
        d *= counted / max(1.0, float(counted.sum()))
        d_states = (d @ self.out.T).reshape(t, b, 2 * HIDDEN)
        table_a, back_a = self.ahead.gradients(x, kept_a, d_states[:, :, :HIDDEN])
        table_b, back_b = self.behind.gradients(x[::-1], kept_b, d_states[::-1, :, HIDDEN:])
        return [table_a, back_a, table_b, back_b, states.T @ d, d.sum(axis=0)]

    def pooled(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        sums = np.zeros((len(texts), len(self.languages) + 1))
        rows, owner, waiting = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            said = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
            for at in range(0, len(said), WINDOW * AT_ONCE):  # a long text goes through in pieces
                piece = said[at:at + WINDOW * AT_ONCE]
                many = -(-len(piece) // WINDOW)
                padded = np.zeros(many * WINDOW, np.uint8)
                padded[:len(piece)] = piece
                rows.append(padded.reshape(many, WINDOW))
                owner.append(np.full(many, i))
                waiting += many
                if waiting >= AT_ONCE:
                    self._add(sums, rows, owner)
                    rows, owner, waiting = [], [], 0
        if rows:
            self._add(sums, rows, owner)
        counted = sums[:, -1]
        mean = sums[:, :-1] / np.maximum(counted, 1)[:, None]
        best = mean.argmax(axis=1)
        score = np.where(counted > 0, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
        named = [self.languages[b] if c > 0 and any(map(str.isalpha, t)) else UNDETERMINED
                 for b, c, t in zip(best, counted, texts)]
        score[[n == UNDETERMINED for n in named]] = 0.0
        return named, score

    def _add(self, sums: np.ndarray, rows: list, owner: list) -> None:
        x, who = np.concatenate(rows), np.concatenate(owner)
        for at in range(0, len(x), AT_ONCE):
            part = np.ascontiguousarray(x[at:at + AT_ONCE].T)
            counted = LETTER[part]
            total = np.einsum("tbl,tb->bl", self.positions(part), counted)
            np.add.at(sums, who[at:at + AT_ONCE], np.concatenate([total, counted.sum(axis=0)[:, None]], axis=1))


def _softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(axis=1, keepdims=True))
    return a / a.sum(axis=1, keepdims=True)


#: 1 for bytes of letters (ASCII letters and all bytes of longer characters).
LETTER = np.array([float(chr(b).isalpha() or b >= 128) for b in range(256)], np.float32)
LETTER[128:] = 1.0


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text",
            lang: str = "lang") -> Network | None:
    """A network fitted to at most ``per_language`` documents of each language that may be learnt from."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()
                       & ~held_out(doc_id)).select(F.col(doc_id).alias("i"), F.col(lang).alias("l"))
    # The rows of smallest hash: about four times as many are let through by their hash alone, so that no
    # language's rank receives more than that, however large the table is.
    often = F.broadcast(known.groupBy("l").agg(F.count(F.lit(1)).alias("n")))  # one row a language
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    let = known.join(often, "l").where(F.xxhash64("i").cast("double") <= F.lit(2.0 ** 64) * share - F.lit(2.0 ** 63))
    chosen = let.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("i").distinct()
    chosen = {r["i"] for r in chosen.collect()}  # bounded: per_language x languages
    if not chosen:
        return None
    length = F.length(text)
    place = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), F.greatest(F.lit(1), length - WINDOW + 1)).cast("int")
    cut = docs.where(F.col(doc_id).isin(chosen) & F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("i"), F.col(lang).alias("l"),
        F.array(*[F.substr(F.col(text), place(k) + 1, F.lit(WINDOW)) for k in range(WINDOWS)]).alias("parts"))
    sample = sorted((r["l"], r["i"], r["parts"]) for r in cut.collect() if r["parts"][0] is not None)
    languages = sorted({s[0] for s in sample})
    if not languages:
        return None
    x, y = [], []
    for name, _, parts in sample:
        for part in parts:
            said = part.lower().encode("utf-8", "replace")[:WINDOW]
            if any(LETTER[b] for b in said):
                x.append(np.frombuffer(said.ljust(WINDOW, b"\0"), np.uint8))
                y.append(languages.index(name))
    if not x:
        return None
    network = Network(languages)
    network.fit(np.stack(x), np.array(y))
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """The documents with ``_lang_pred`` and ``_lang_score``."""
    schema = StructType([*docs.schema.fields, StructField("_lang_pred", StringType()), StructField("_lang_score", DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for lo in range(0, batch.num_rows, 512):
                texts = batch.column(at).slice(lo, 512).to_pylist()
                if shared.value is None:
                    named, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                else:
                    named, score = shared.value.pooled(texts)
                names.extend(named)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64())],
                names=schema.names)

    return docs.mapInArrow(run, schema)
