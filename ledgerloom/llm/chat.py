r"""Chat formatting with a grammar round trip.

The template, as a grammar over the control strings ``<|im_start|>``, ``<|im_end|>``
and ``<|im_nl|>``::

    conversation = turn*
    turn         = "<|im_start|>" role "\n" text "<|im_end|>\n"

Inside a role or text, ``<``, k backslashes and ``|`` stand for ``<``, k - 1
backslashes and ``|``; ``<|im_nl|>`` stands for a line break in a role. So an
unescaped ``<|`` is always a control string, and one left-to-right pass parses any
output. Each turn is first rendered as it is, parsed again and compared to its
source; content that conflicts with the grammar is escaped one level further until
the recovered turn is identical. Every turn starts and ends on its own, so turns
are checked where they lie, a conversation of any length never has to meet in one
place for it, and the concatenation parses as its parts do.

The output has one row per turn, in the order of ``turn`` (ties by role, then text):
its formatted segment and the span of it under the loss mask (the text of assistant
turns). The digest of a conversation hashes its recovered turns one after another:
SHA-256 is sequential, so this last step streams a conversation's turns through one
task, a turn at a time, after Spark has sorted them.

Defined cases: null text or role is empty; a null conversation id is a conversation
of its own; repeated rows are turns of their own; turns without a number come first.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END, LINE, ASSISTANT = "<|im_start|>", "<|im_end|>", "<|im_nl|>", "assistant"
MARK = re.compile(r"<(\\*)\|")


def escape(text: str, level: int) -> str:
    """``level`` backslashes more in every ``<|``-like place."""
    return MARK.sub(lambda m: "<" + m[1] + "\\" * level + "|", text) if level else text


def unescape(text: str) -> str:
    return MARK.sub(lambda m: "<" + m[1][1:] + "|", text)


class GrammarError(ValueError):
    pass


def _content(formatted: str, at: int) -> int:
    """Where the next control string begins."""
    for found in MARK.finditer(formatted, at):
        if not found[1]:
            return found.start()
    raise GrammarError("text without an end")


def _take(formatted: str, at: int, wanted: str) -> int:
    if not formatted.startswith(wanted, at):
        raise GrammarError(f"{wanted!r} expected at {at}")
    return at + len(wanted)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; the span holds the text as formatted."""
    turns, at = [], 0
    while at < len(formatted):
        at = _take(formatted, at, START)
        role = ""
        while True:
            stop = formatted.find("\n", at)
            control = _content(formatted, at)
            if 0 <= stop < control:
                role += unescape(formatted[at:stop])
                break
            role += unescape(formatted[at:control]) + "\n"
            at = _take(formatted, control, LINE)
        start = stop + 1
        end = _content(formatted, start)
        at = _take(formatted, _take(formatted, end, END), "\n")
        turns.append((role, unescape(formatted[start:end]), start, end))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, formatted with as little escaping as the round trip needs, and its text's span."""
    for level in range(2):
        # Breaks in a role are always marked, after its own marks are escaped.
        head = LINE.join(escape(part, level) for part in role.split("\n"))
        formatted = f"{START}{head}\n{escape(text, level)}{END}\n"
        try:
            turns = parse(formatted)
        except GrammarError:
            continue
        if [turn[:2] for turn in turns] == [(role, text)]:
            return formatted, turns[0][2], turns[0][3]
    raise AssertionError("escaping must make every turn recoverable")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_end): one row per row of ``conversations``.

    A conversation's formatted text is its segments in order; the loss span is null
    outside assistant turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            made = [render(r, t or "") for r, t in zip(roles, batch.column("text").to_pylist())]
            counts = [r == ASSISTANT for r in roles]
            yield pa.record_batch(
                {
                    "conv_id": batch.column("conv_id"),
                    "turn": batch.column("turn"),
                    "role": pa.array(roles, pa.string()),
                    "segment": pa.array([m[0] for m in made], pa.string()),
                    "loss_start": pa.array([m[1] if c else None for m, c in zip(made, counts)], pa.int64()),
                    "loss_end": pa.array([m[2] if c else None for m, c in zip(made, counts)], pa.int64()),
                }
            )

    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        run,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, segment string, loss_start long, loss_end long",
    )


class Digest:
    """Counts and hashes of one conversation, read back from its formatted segments."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        for role, text, _, _ in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(segment[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation: turn count, hash of its turns, masked text and length."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kinds = None, None
        for batch in batches:
            done = []
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))
            for conv_id, segment, start, end in zip(*columns):
                if current is None or current.conv_id != conv_id:
                    done += [current.row()] if current else []
                    current = Digest(conv_id)
                current.add(segment, start, end)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)
        if current is not None:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(current.row(), kinds)], names=names)

    # Turns that tie in number and role go by their text, so the end mark and the escapes come off first.
    content = F.substring("segment", F.lit(1), F.length("segment") - len(END) - 1)
    text = F.regexp_replace(content, r"<(\\*)\\\|", "<$1|")
    ordered = segments.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", text)
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
