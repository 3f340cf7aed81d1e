"""Chat formatting from event logs.

A conversation is a log of events. The log is dealt by conversation and message,
so that one huge conversation still spreads, and sorted by sequence; each
message's streamed deltas, edits and regenerations fold into its final text. The
messages are dealt by ranges of conversation and place, and rendered with a
template that marks turns and escapes control strings inside texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of events: a message begins; text is added to it; its text is replaced;
#: its text so far is thrown away; the message goes.
KINDS = ("start", "delta", "edit", "regenerate", "delete")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text in which no control string can occur: a backslash is put between each
    < and | (and before those already there), which unescape takes away."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape, with line ends as \\n too: a role is a line of its own."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its escaped text."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def fold(events: Iterable[tuple[str, str]]) -> str | None:
    """The final text of one message's (kind, text) events; None if deleted."""
    parts: list[str] | None = []
    for kind, text in events:
        if kind == "delete":
            parts = None
        elif kind in ("start", "regenerate"):
            parts = [text] if text else []
        elif kind == "edit":
            parts = [text]
        elif kind == "delta":
            if parts is not None:
                parts.append(text)
        else:
            raise ValueError(f"unknown event kind {kind!r}")
    return None if parts is None else "".join(parts)


MESSAGES = "conv_id long, place long, copy long, role string, text string"


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages of a log (conv_id, place, copy, seq, kind, role, text): the
    message is (conv_id, place, copy) and its events follow seq. Null texts are
    empty; the role is that of the start event; a message without events left
    isn't there. Events of one message stay in one task, which holds one message
    at a time."""
    spark = log.sparkSession
    common.bounded_batches(spark)
    key = ["conv_id", "place", "copy"]
    dealt = log.select(*key, "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition(common.parallelism(spark), *key).sortWithinPartitions(*key, "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, events = None, "", []
        out: list[tuple] = []

        def flush() -> None:
            if events and (text := fold(events)) is not None:
                out.append((*now, role, text))

        for batch in batches:
            for *name, _, kind, r, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if now is not None:
                        flush()
                    now, role, events = name, "", []
                if kind == "start":
                    role = r
                events.append((kind, text))
            if out:
                yield _messages(out)
                out = []
        if now is not None:
            flush()
        if out:
            yield _messages(out)

    return dealt.mapInArrow(common.given_back(run), MESSAGES)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MESSAGES.split(", ")])


FORMATTED = "conv_id long, place long, copy long, formatted string, mask_from int, mask_to int"


def format_messages(messages: DataFrame) -> DataFrame:
    """Rendered turns in conversation order: FORMATTED. Code points from mask_from
    up to mask_to bear loss; both are null outside assistant turns. messages should be
    a stored table, as finding the ranges reads it once more."""
    common.bounded_batches(messages.sparkSession)
    order = ["conv_id", "place", "copy"]
    dealt = messages.repartitionByRange(common.parallelism(messages.sparkSession), *order).sortWithinPartitions(*order)

    def run(c: dict[str, list]) -> dict[str, list]:
        made = [render(r, t) for r, t in zip(c["role"], c["text"], strict=True)]
        loss = [r == "assistant" for r in c["role"]]
        return {n: c[n] for n in order} | {"formatted": [m[0] for m in made], "mask_from": [m[1] if x else None for m, x in zip(made, loss, strict=True)], "mask_to": [m[2] if x else None for m, x in zip(made, loss, strict=True)]}

    return common.map_rows(dealt, FORMATTED, run)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations in a formatted table: DIGEST. Turns are parsed
    from the rendered strings. A conversation's turns pass one task in order, one
    at a time, as a hash of all of them needs; nothing is gathered."""
    spark = formatted.sparkSession
    common.bounded_batches(spark)
    order = ["conv_id", "place", "copy"]
    dealt = formatted.repartition(common.parallelism(spark), "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close(s) -> tuple:
            conv, n, turns, chars, loss, total = s
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            out = []
            c = dict(zip(batch.schema.names, (x.to_pylist() for x in batch.columns), strict=True))
            for conv, text, lo, hi in zip(c["conv_id"], c["formatted"], c["mask_from"], c["mask_to"], strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if lo is not None:
                    loss = unescape(text[lo:hi])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(close(state), kinds, strict=True)], names=names)

    return dealt.mapInArrow(common.given_back(run), DIGEST)


def log_of(turns: DataFrame) -> DataFrame:
    """An event log whose messages are the rows of turns (conv_id, turn, role,
    text): each text arrives as two deltas; an assistant's first draft is thrown
    away by a regeneration; another's first wording is edited. Rows that repeat a
    turn are messages of their own, ordered by role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "place").orderBy("role", "text")).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, second = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.char_length("text"))

    def events(*given: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), t.alias("text")) for i, (k, t) in enumerate(given)])

    none = F.lit("")
    drafted = events(("start", none), ("delta", F.lit("draft ")), ("delta", first), ("regenerate", none), ("delta", first), ("delta", second))
    edited = events(("start", none), ("delta", second), ("edit", first), ("delta", second))
    made = F.when(F.col("role") == "assistant", drafted).otherwise(edited)
    return rows.select("conv_id", "place", "copy", "role", F.explode(made).alias("e")).select("conv_id", "place", "copy", "e.seq", "e.kind", "role", "e.text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted table of turns (see log_of), written and read again.

    Turns go by turn (null first); null roles and texts are empty; an empty table
    gives an empty result; other columns are ignored. A null conv_id is a
    conversation too; ids that are no numbers raise. A text of any length is one
    turn, and a task holds one turn at a time.
    """
    return common.stored(format_messages(common.stored(reconstruct(log_of(turns)), "chat-messages")), "chat")
