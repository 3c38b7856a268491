"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_SEGMENT = re.compile(r"<\|im_start\|>((?:[^\n<]|<(?!\|))*)\n(.*?)<\|im_end\|>\n", re.S)

#: Characters after which a part of an example's context is closed, at the end of a turn.
PART_CHARS = 1 << 18
#: Characters that a task hands on at a time, beside one part.
HELD_CHARS = 1 << 22

EXAMPLES = "conv_id long, example long, part long, last boolean, trainable boolean, text string, start_char long, loss_start long, loss_end long"
READ = "conv_id long, example long, part long, last boolean, chars long, n_turns long, turns string, reply string"


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash more goes into each ``<|``, ``<\\|``, ``<\\\\|`` and so on."""
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_conversations(df: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Every assistant turn as an example of its own: all preceding turns as context, and only the reply trainable.

    Takes conv_id, turn, role, text.  Each example is spelled out, its context with it,
    so output grows with the square of a conversation's length.  An example is a row,
    or several by ``part`` where its context is longer than ``part_chars``; parts end
    where turns end and make the example end to end.  ``start_char`` is a part's place in
    its example.  The last part ends with the reply and is ``trainable``: the example's
    characters from ``loss_start`` to ``loss_end``.

    Turns after the last reply belong to one more example with nothing trainable.  The
    ``last`` example of a conversation so holds all its turns.

    Turns go by ``turn``, nulls first, then role and text; repeated rows are turns of
    their own.  A null role or text is empty.  Rows of a null conv_id are one
    conversation.  One task streams a conversation and holds its turns once.
    """
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def examples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        own = None
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if own and conv_id != own.conv:
                    yield from own.example(last=True)
                    own = None
                elif own and own.loss:
                    yield from own.example(last=False)
                own = own or _Stream(conv_id, part_chars)
                own.add(role, text)
        if own:
            yield from own.example(last=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in examples(batches):
            out.append(row)
            size += len(row[5])
            if size >= HELD_CHARS:
                yield _batch(out, EXAMPLES)
                out, size = [], 0
        yield _batch(out, EXAMPLES)

    return map_batches(rows, run, EXAMPLES)


class _Stream:
    """A conversation's formatted turns so far: the context of its next example."""

    def __init__(self, conv, part_chars: int):
        self.conv, self.part_chars = conv, part_chars
        self.closed, self.starts, self.open, self.place, self.examples, self.loss = [], [], "", 0, 0, None

    def add(self, role: str, text: str) -> None:
        """One more turn; ``place`` is where the open part begins."""
        if len(self.open) >= self.part_chars:
            self.closed.append(self.open)
            self.starts.append(self.place)
            self.place, self.open = self.place + len(self.open), ""
        body = escape(text)
        self.open += f"{START}{escape_role(role)}\n"
        a = self.place + len(self.open)
        self.open += body + END
        self.loss = (a, a + len(body)) if role == TARGET_ROLE else None

    def example(self, last: bool) -> Iterator[tuple]:
        """The parts of the example that ends with the turn added last."""
        for part, (text, start) in enumerate(zip(self.closed, self.starts, strict=True)):
            yield self.conv, self.examples, part, last, False, text, start, None, None
        yield self.conv, self.examples, len(self.closed), last, bool(self.loss), self.open, self.place, *(self.loss or (None, None))
        self.examples += 1


_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def materialise(examples: DataFrame) -> DataFrame:
    """The examples of ``format_conversations``, one row each, cut by the mask: conv_id, example, context, target, tail.

    Each row holds its whole context; meant for conversations that fit a training window.
    """
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    rows = examples.groupBy("conv_id", "example").agg(F.concat_ws("", F.transform(parts, lambda x: x["text"])).alias("whole"), F.max("loss_start").alias("a"), F.max("loss_end").alias("b"))
    a, b = F.coalesce("a", F.length("whole")), F.coalesce("b", F.length("whole"))
    return rows.select(
        "conv_id",
        "example",
        F.substring("whole", F.lit(1), a.cast("int")).alias("context"),
        F.substring("whole", (a + 1).cast("int"), (b - a).cast("int")).alias("target"),
        F.substring("whole", (b + 1).cast("int"), F.length("whole")).alias("tail"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What a reader of the formatted examples gets, for each conversation.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn of the
    last example, which has them all), loss_chars and loss_sha256 (the unescaped text
    under the loss mask of all examples in order), n_examples, formatted_chars
    (characters of all examples) and stream_chars (of the last).  Examples are read
    where they lie; only turns of last examples and replies are shuffled.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, example, part, last, trainable, text, start, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = [f"{unescape_role(x[1])}\n{unescape(x[2])}\n" for x in _SEGMENT.finditer(text)] if last else []
                reply = unescape(text[a - start : b - start]) if trainable else None
                out.append((conv, example, part, last, len(text), len(turns), "".join(turns), reply))
            yield _batch(out, READ)

    rows = map_batches(examples.select(*(x.split()[0] for x in EXAMPLES.split(", "))), read, READ)
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "example", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, n_examples long, formatted_chars long, stream_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, state = object(), [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[0] != conv:
                    if state:
                        out.append(state.row(conv))
                    conv, state = row[0], _Reader()
                state.part(*row[2:])
            yield _batch(out, schema)
            out = []
        if state:
            yield _batch([state.row(conv)], schema)

    return map_batches(rows, run, schema)


class _Reader:
    """Sums up what was read of one conversation's examples, a part at a time."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.examples = self.formatted = self.stream = 0

    def part(self, part, last, chars, n_turns, turns, reply) -> None:
        self.formatted += chars
        self.examples += part == 0
        if last:
            self.n_turns += n_turns
            self.turns.update(turns.encode())
            self.stream += chars
        if reply is not None:
            self.loss.update(reply.encode())
            self.loss_chars += len(reply)

    def row(self, conv) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.examples, self.formatted, self.stream
