"""Chat formatting from event logs.

A conversation is a log of events in sequence order: messages, streamed deltas, edits and regenerations. Logs
are partitioned by conversation and sorted by sequence, so a task folds one conversation after the other from a
stream and holds one at a time. The final messages are rendered with a template that marks turns and roles;
control strings inside roles and texts are escaped reversibly. A loss mask holds the code-point spans of
assistant texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: The template's marks. A turn is TURN role SAYS text END.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of common templates; none of them can occur in an escaped text.
CONTROL = ("<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Double each backslash, and break each control string by a backslash behind its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Conversation:
    """The state of a conversation: its turns so far, from events in order. What an event replaces is held no longer.

    message: a turn with this text, behind all others if its number is null or new, else in place of the old.
    delta: text put behind the turn's; a new turn if there is none. edit: the turn's text becomes this.
    regenerate: the turn's text is emptied, and every later turn goes; deltas that follow fill it again.
    Edits and regenerations of turns that don't exist have no effect.
    """

    def __init__(self):
        self.turns: dict = {}
        self.events = 0

    def feed(self, kind: str, turn: int | None, role: str, text: str) -> None:
        key, turns = ("new", self.events) if turn is None else turn, self.turns
        self.events += 1
        if kind == "message" or (kind == "delta" and key not in turns):
            turns[key] = [role, [text]]
        elif kind == "delta":
            turns[key][1].append(text)
        elif kind == "edit" and key in turns:
            turns[key][1] = [text]
        elif kind == "regenerate" and key in turns:
            turns[key][1] = []
            order = list(turns)
            for later in order[order.index(key) + 1 :]:
                del turns[later]
        elif kind not in ("edit", "regenerate"):
            raise ValueError(f"unknown kind of event: {kind}")

    def final(self) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        return [(role, "".join(parts)) for role, parts in self.turns.values()]


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) turns from events (kind, turn, role, text) in order."""
    state = Conversation()
    for event in events:
        state.feed(*event)
    return state.final()


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the code-point spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(TURN).split(SAYS, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def format_conversations(events: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_spans)`` for each conversation of an event log.

    ``events`` has conv_id, seq, kind, turn, role, text. Order: seq (nulls first), then turn, role, text, kind,
    so ties are settled. Null roles and texts count as empty, a null kind as message; a null conv_id is one
    conversation. Extra columns are ignored; an empty log gives no rows.
    """
    bound_batches(events.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "role", "text", "kind").select("conv_id", "kind", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        done: list[tuple] = []
        current, state = None, None

        def close():
            turns = state.final()
            text, spans = render(turns)
            done.append((current, len(turns), text, [list(s) for s in spans]))

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            for conv, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, Conversation()
                state.feed(*event)
            if done:
                yield emit()
        if state is not None:
            close()
            yield emit()

    return log.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<array<long>>")
