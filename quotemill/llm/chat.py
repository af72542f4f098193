"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context (the prefix), only that reply
(the target) is trainable. ``examples`` writes each one out with its whole context. A conversation of n turns holds
up to n examples whose contexts repeat each other, n * n / 2 turns of text: they are formed and read in streams and
never shuffled or stored. ``segments`` is the shared form below them, in which a *segment* is what an example adds to
the one before it and example k reads as the segments 0..k; it grows with the input.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts each ``<|`` is written
``<||``; no control string starts that way, so the escape is reversible and nothing inside a text can
end a turn.

Cases: NULL text or role is empty; rows of one conversation are ordered by turn (NULL first), then role, then
text (repeated rows count as turns); conversations without assistant turns have only a tail (``example`` NULL);
NULL conv_id is a conversation of its own; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings. Fixed values.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"

_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escaped(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, seq, example, context_chars, text, loss_start, loss_end: one row per turn, in shared form.

    ``example`` is the first example that holds the turn (0, 1.. per conversation; NULL behind the last
    reply). ``loss_start`` and ``loss_end`` (code points in ``text``, end exclusive) are set on the reply
    that closes the example. ``context_chars`` is the formatted length before this turn.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.col("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, F.coalesce("text", F.lit("")))
    running = in_order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    trained = role == TRAINED_ROLE
    rows = turns.select(
        "conv_id", (F.row_number().over(in_order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum(trained.cast("long")).over(running), F.lit(0)).alias("example"),
        F.sum(trained.cast("long")).over(Window.partitionBy("conv_id")).alias("_examples"),
        F.concat(head, text, F.lit(END)).alias("text"),
        F.when(trained, F.length(head)).cast("long").alias("loss_start"),
        F.when(trained, F.length(head) + F.length(text)).cast("long").alias("loss_end"),
        F.coalesce(F.sum((F.length(head) + F.length(text) + len(END)).cast("long")).over(running), F.lit(0))
        .alias("context_chars"))
    return rows.select("conv_id", "seq", F.when(F.col("example") < F.col("_examples"), F.col("example")).alias("example"),
                       "context_chars", "text", "loss_start", "loss_end")


#: Characters of examples handed on at a time.
CHARS_AT_ONCE = 1 << 24

EXAMPLES = "conv_id long, example long, seq long, context_chars long, context string, reply string, loss_start long, loss_end long"


def expanded(shared: DataFrame) -> DataFrame:
    """The formatted output: every example written out, then the turns behind a conversation's last reply.

    A row with ``example`` is a prefix and its target: ``context`` holds all turns before the reply, whole, ``reply``
    the formatted reply. Rows without ``example`` hold a turn of the tail as ``reply``; nothing of it is trained on.
    Rows of a conversation stand together and in order. A worker holds the text of one conversation so far, and
    the examples it is about to hand on.
    """
    in_order = shared.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return in_order.mapInArrow(_expand, EXAMPLES)


def examples(shared: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, seq, context_chars, context, reply, loss_start, loss_end.

    An example's text is its ``context`` (the formatted turns before the reply, ``context_chars`` code points) and its
    formatted ``reply``. Only the places from ``loss_start`` to ``loss_end`` (code points of that text, end
    exclusive) are trained on.
    """
    return expanded(shared).where("example IS NOT NULL")


def full_texts(shared: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: every example as one text, contexts repeated."""
    return examples(shared).select("conv_id", "example", F.concat("context", "reply").alias("text"), "loss_start", "loss_end")


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, n_examples long")


def read_back(shared: DataFrame) -> DataFrame:
    """Parses the written examples again and digests what they hold, one row per conversation.

    Turns are read out of the contexts and replies as they stand in the examples, what is trained on is cut out of
    them by their masks. Each context must begin with the example before it, else it is an error.
    """
    return expanded(shared).mapInArrow(_digests, READ_BACK)


_NONE = object()


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.string())
                                       for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, before, since, done, held = _NONE, "", [], [], 0
    for conv, seq, example, chars, text, start, end in _rows(
            batches, "conv_id", "seq", "example", "context_chars", "text", "loss_start", "loss_end"):
        if now is _NONE or conv != now:
            now, before, since = conv, "", []
        if start is not None:
            before, since = before + "".join(since), [text]
            done.append((conv, example, seq, chars, before, text, chars + start, chars + end))
            held += len(before)
        elif example is None:
            done.append((conv, None, seq, chars, None, text, None, None))
        else:
            since.append(text)
        held += len(text)
        if held >= CHARS_AT_ONCE:
            yield _batch(done, EXAMPLES)
            done, held = [], 0
    yield _batch(done, EXAMPLES)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss, self.examples = conv, 0, 0, 0, 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()
        self.before = ""

    def read(self, text: str) -> None:
        for m in _TURN.finditer(text):
            role, said = unescaped(m[1]), unescaped(m[2])
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        self.chars += len(text)

    def example(self, context: str, chars: int, reply: str, start: int, end: int) -> None:
        if chars != len(context) or not context.startswith(self.before):
            raise ValueError(f"example {self.examples} of conversation {self.conv} does not continue its context")
        self.read(context[len(self.before):])
        self.read(reply)
        self.before = context + reply
        masked = unescaped(self.before[start:end])
        self.trained.update(masked.encode())
        self.loss += len(masked)
        self.examples += 1

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars,
                self.examples)


#: Digests handed on at a time.
ROWS_AT_ONCE = 4096


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for conv, example, chars, context, reply, start, end in _rows(
            batches, "conv_id", "example", "context_chars", "context", "reply", "loss_start", "loss_end"):
        if now is None or now.conv != conv:
            if now is not None:
                done.append(now.row())
            now = _Digest(conv)
            if len(done) >= ROWS_AT_ONCE:
                yield _batch(done, READ_BACK)
                done = []
        if example is None:
            now.read(reply)
        else:
            now.example(context, chars, reply, start, end)
    if now is not None:
        done.append(now.row())
    yield _batch(done, READ_BACK)
