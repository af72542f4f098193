"""Benchmark decontamination: edit distance through a random-walk embedding and bit-sampling LSH.

Texts and items are sequences of words (lower case, without punctuation). An item of n words leaks into
a text if a stretch of it is within ``floor((1 - similarity) * n)`` word edits.

1. Windows of the item's size: an edit touches one word, so of any d + 1 places of an item at least one
   survives d edits. The d + 1 longest words of every item are its anchors; wherever a text holds one,
   the window that would put it at its place is looked at. No leak lies outside of these windows.
2. CGK embedding: a walk over the window repeats or passes a word by a random bit of (step, word), so
   few edits become few differing steps. One repetition reads ``samples`` steps, spread over the walk,
   and looks the values up among the items' own. The number of repetitions is the least that reaches
   ``recall`` on the items themselves, edited at random as far as allowed, and again on fresh edits; if
   none does, that is an error.
3. Every hit is verified exactly: word edit distance of the item to its best stretch around the window.

The benchmark is held by every task, ``ITEM_WORDS_AT_ONCE`` words at a time; a larger one is searched
in several passes. Items and windows are worked on by size class, so a long item does not widen the others.
Texts are never shuffled.

Items too short for an edit (four words at 0.8) are matched word for word. ``decontaminated`` leaves out
items of fewer than ``min_words`` words, because prose holds those by chance; ``find_leaks`` reports them.

Cases: NULL or empty texts hold nothing; items without words are never found; repeated items are reported each, repeated rows each; all
occurrences that don't overlap are found, ties going to the earlier; empty tables give no rows; extra
columns are ignored, columns of the documents may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_hashes, without_rows

#: Words of items that a task holds at a time (longer benchmarks are searched in passes), and of windows.
ITEM_WORDS_AT_ONCE, CELLS_AT_ONCE = 1_000_000, 3_000_000
#: Repetitions tried before a recall counts as out of reach.
MOST_REPETITIONS = 256
_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(32 if not chr(b).isalnum() else ord(chr(b).lower()) for b in range(128)) + bytes([32] * 128)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal words give equal bits, others unrelated ones."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(windows: np.ndarray, sizes: np.ndarray, rep: int, samples: int) -> np.ndarray:
    """Sampled values of one random walk per row. Rows are padded and ordered by size, largest first."""
    rng = np.random.default_rng([7, rep])
    salt, at = np.uint64(rng.integers(1 << 63)), np.sort(rng.random(samples))
    rows, width = windows.shape
    last = (at[-1] * 2 * sizes).astype(np.int64)  # no row walks beyond its last sampled step
    steps = int(last[0]) + 1 if rows else 0
    values = mixed(windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
    values[np.arange(width) >= sizes[:, None]] = 0  # a zero never moves on, so no walk leaves its row
    values = np.concatenate([values, np.zeros((rows, 1), np.uint64)], axis=1).ravel()
    place = np.arange(rows) * (width + 1)
    seen = np.zeros((steps, rows), np.uint64)
    live = np.searchsorted(-last, -np.arange(steps), side="right")
    for j in range(steps):
        m = live[j]
        now = values[place[:m]]
        seen[j, :m] = now
        place[:m] += ((now >> np.uint64(j * 37 % 64)) & np.uint64(1)).astype(np.int64)
    out = mixed(sizes.astype(np.uint64))
    with np.errstate(over="ignore"):
        for u in at:
            out = mixed(out * np.uint64(31) + seen[(u * 2 * sizes).astype(np.int64), np.arange(rows)])
    return out


def best_stretch(item: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the whole item to a stretch of the text, and the first end reaching it.

    Bit-parallel columns, so any length is exact. ``anchored``: the stretch starts where the text starts.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (~(diagonal | up) & full), up & diagonal
        score += bool(more & top) - bool(less & top)
        more = (more << 1 | anchored) & full
        less = less << 1 & full
        up, down = less | (~((eq | down) | more) & full), more & (eq | down)
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """The benchmark as tasks use it: word ids, anchors, and the signatures of every repetition."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float, samples: int, min_words: int):
        said = [(i, words_of(t)) for i, t in rows]
        said = sorted(((i, w) for i, w in said if len(w) >= min_words), key=lambda x: -len(x[1]))
        self.ids = [i for i, _ in said]
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w] for _, w in said]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        if not said:
            return
        common = Counter(x for _, w in said for x in w)
        anchors: dict[int, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(said):
            rare = sorted(range(len(w)), key=lambda o: (-len(w[o]), common[w[o]], o))[:int(self.edits[k]) + 1]
            for o in rare:
                anchors.setdefault(self.words[k][o], []).append((k, o))
        size = len(self.vocabulary) + 2
        counts = np.zeros(size, np.int64)
        for w, places in anchors.items():
            counts[w] = len(places)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        flat = [p for w in range(size) for p in anchors.get(w, [])]
        self.anchor_item = np.array([k for k, _ in flat], np.int64)
        self.anchor_place = np.array([o for _, o in flat], np.int64)
        self.anchors = counts
        self._repeat(recall, samples)

    def signed(self, rows: list, sizes: np.ndarray, rep: int, samples: int) -> np.ndarray:
        """Signatures of rows of word ids; rows are padded to the widest of their size class, not of all."""
        out = np.zeros(len(rows), np.uint64)
        classes = np.frexp(sizes)[1]
        for c in np.unique(classes):
            mine = np.nonzero(classes == c)[0]
            mine = mine[np.argsort(-sizes[mine], kind="stable")]
            width = int(sizes[mine[0]])
            for lo in range(0, len(mine), max(1, CELLS_AT_ONCE // width)):
                part = mine[lo:lo + max(1, CELLS_AT_ONCE // width)]
                padded = np.zeros((len(part), int(sizes[part[0]])), np.int64)
                for i, k in enumerate(part.tolist()):
                    row = rows[k][:int(sizes[k])]
                    padded[i, :len(row)] = row
                out[part] = signatures(padded, sizes[part], rep, samples)
        return out

    def _edited(self, k: int, rng: np.random.Generator) -> list[int]:
        """A window of the item's size over an edited copy, placed by a word that survived."""
        words, kept = list(self.words[k]), list(range(len(self.words[k])))
        for _ in range(int(self.edits[k])):
            at, what = int(rng.integers(len(words))), rng.integers(3)
            if what == 0:
                words[at], kept[at] = int(rng.integers(len(self.vocabulary))) + 1, -1
            elif what == 1 and len(words) > 1:
                del words[at], kept[at]
            else:
                words.insert(at, int(rng.integers(len(self.vocabulary))) + 1)
                kept.insert(at, -1)
        left = [i for i, o in enumerate(kept) if o >= 0]
        i = left[int(rng.integers(len(left)))]
        start = i - kept[i]
        window = words[max(start, 0):start + len(self.words[k])]
        return [0] * max(-start, 0) + window

    def _edits(self, seed: int) -> tuple[np.ndarray, list[list[int]]]:
        """Items drawn at random, twice each, and windows over copies edited as far as allowed."""
        rng = np.random.default_rng(seed)
        who = np.repeat(np.sort(rng.choice(len(self.words), size=min(400, len(self.words)), replace=False)), 2)
        return who, [self._edited(k, rng) for k in who]

    def _repeat(self, recall: float, samples: int) -> None:
        """Repetitions that reach the recall on one set of edits, and on a second one that nothing was fitted to.

        The second set may fall short by two standard errors. If no number of repetitions does, that is an error.
        """
        sets = [self._edits(seed) for seed in (11, 12)]
        goals = [recall, recall - 2 * (recall * (1 - recall) / len(sets[1][0])) ** 0.5]
        for self.samples in range(samples, 0, -1):
            hits = [np.zeros(len(who), bool) for who, _ in sets]
            self.repetitions = 0
            while any(h.mean() < g for h, g in zip(hits, goals)) and self.repetitions < MOST_REPETITIONS:
                for hit, (who, edited) in zip(hits, sets):
                    own = [self.words[k] for k in who]
                    hit |= (self.signed(edited, self.sizes[who], self.repetitions, self.samples)
                            == self.signed(own, self.sizes[who], self.repetitions, self.samples))
                self.repetitions += 1
            if all(h.mean() >= g for h, g in zip(hits, goals)):
                break
        else:
            raise ValueError(f"recall {recall} is not reached by {MOST_REPETITIONS} repetitions: "
                             f"{[float(h.mean()) for h in hits]}; allow fewer edits or less recall")
        self.repetitions = max(self.repetitions, 4)
        self.tables = []
        for rep in range(self.repetitions):
            values = self.signed(self.words, self.sizes, rep, self.samples)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))


def search(items: Items, texts: Iterator[tuple[int, list[str]]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end) for every leak in numbered texts; start and end count words."""
    get = items.vocabulary.get
    waiting, held = [], 0
    for row, words in texts:
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        at = np.nonzero(items.anchors[ids])[0] if len(ids) else ids
        if not len(at):
            continue
        many = items.anchors[ids[at]]
        one = np.repeat(items.first[ids[at]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        start = np.repeat(at, many) - items.anchor_place[one]
        found = np.unique(np.stack([start, items.sizes[items.anchor_item[one]]]), axis=1)
        piece = np.cumsum(found[1]) // CELLS_AT_ONCE
        for c in np.unique(piece):
            part = found[:, piece == c]
            waiting.append((row, ids, part[0], part[1]))
            held += int(part[1].sum())
            if held >= CELLS_AT_ONCE:
                yield from _verified(items, waiting)
                waiting, held = [], 0
    if waiting:
        yield from _verified(items, waiting)


def _window(ids: np.ndarray, start: int, size: int) -> np.ndarray:
    """Words from ``start`` on; zeros where the window begins before the text."""
    if start >= 0:
        return ids[start:start + size]
    return np.concatenate([np.zeros(min(-start, size), np.int64), ids[:max(start + size, 0)]])


def _verified(items: Items, waiting: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    sizes = np.concatenate([w[3] for w in waiting])
    starts = np.concatenate([w[2] for w in waiting])
    owner = np.repeat(np.arange(len(waiting)), [len(w[2]) for w in waiting])
    windows = [_window(waiting[o][1], i, n) for o, i, n in zip(owner.tolist(), starts.tolist(), sizes.tolist())]
    hits = []
    for rep, (values, whose) in enumerate(items.tables):
        mine = items.signed(windows, sizes, rep, items.samples)
        lo, hi = np.searchsorted(values, mine, side="left"), np.searchsorted(values, mine, side="right")
        some = np.nonzero(hi > lo)[0]
        many = (hi - lo)[some]
        if len(some):
            one = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            hits.append(np.stack([owner[np.repeat(some, many)], whose[one], starts[np.repeat(some, many)]]))
    if not hits:
        return
    exact: dict[tuple[int, int], set] = {}
    for o, k, start in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
        item, d = items.words[k], int(items.edits[k])
        from_ = max(0, start - 2 * d)
        text = waiting[o][1][from_:start + len(item) + 2 * d].tolist()
        distance, end = best_stretch(item, text)
        if distance <= d:
            _, length = best_stretch(item[::-1], text[:end][::-1], anchored=True)
            exact.setdefault((o, k), set()).add((distance, from_ + end - length, from_ + end))
    for (o, k), found in exact.items():
        taken: list[tuple[int, int]] = []
        for distance, start, end in sorted(found):
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                yield waiting[o][0], k, distance, start, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99,
               samples: int = 2, min_words: int = 1, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, similarity, start_word, end_word: every leak of an item into a document."""
    found = _leaks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark,
                   similarity, recall, samples, min_words, item_id, item_text)
    return found.drop("h1", "h2")


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float, recall: float, samples: int, min_words: int,
           item_id: str, item_text: str) -> DataFrame:
    """Leaks into rows of doc_id, text, with two hashes of the row's text."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    rows = rows.where("t IS NOT NULL").orderBy("i", "t").toLocalIterator()
    schema = "doc_id long, h1 long, h2 long, item_id long, distance long, similarity double, start_word long, end_word long"
    slim = docs.select("doc_id", *text_hashes(F.col("text")), "text")
    passes, chunk, held = [], [], 0
    for r in rows:
        size = len(words_of(r["t"]))
        if chunk and held + size > ITEM_WORDS_AT_ONCE:
            passes.append(chunk)
            chunk, held = [], 0
        chunk.append((r["i"], r["t"]))
        held += size
    passes.append(chunk)
    found = []
    for chunk in passes:
        items = Items(chunk, similarity, recall, samples, min_words)
        if items.ids:
            shared = docs.sparkSession.sparkContext.broadcast(items)
            found.append(slim.mapInArrow(_searched(shared), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, names = shared.value, []

        def texts() -> Iterator[tuple[int, list[str]]]:
            for batch in batches:
                for *name, said in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                    names.append(name)
                    yield len(names) - 1, words_of(said.as_py())

        out = []
        for row, k, distance, start, end in search(items, texts()):
            out.append((*names[row], items.ids[k], distance, 1 - distance / int(items.sizes[k]), start, end))
        columns = list(zip(*out)) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["doc_id", "h1", "h2", "item_id", "distance", "similarity", "start_word", "end_word"])
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, samples: int = 2,
                   min_words: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The rows whose text no item leaks into, whatever other rows share their doc_id."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = _leaks(slim, benchmark, similarity, recall, samples, min_words, item_id, item_text)
    return without_rows(docs, gone, doc_id, text)
