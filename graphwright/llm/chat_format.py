"""Chat formatting by event-sourced reconstruction.

A log holds what happened to messages: opened, extended by streamed deltas, replaced by edits,
regenerated, deleted. Sorted by sequence, the events of each message are folded into its final text;
the messages of a conversation, in the order in which they began, are then rendered with turn marks.
Control strings inside texts are broken by a backslash, so that only the template's own marks are
left, and backslashes are doubled, so that the text can be read back.

Messages are folded wherever they lie, also those of one very long conversation; only digests over
whole conversations follow the order of turns, one turn after another and without holding them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import slices

# Strings that mark turns, here or in other templates, and may not stand in a text.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Roles whose text is under the loss mask.
LEARNED_ROLES = frozenset({"assistant"})

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\([\s\S])")
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*)<\|im_end\|>\n")


def escape(text: str) -> str:
    """The text without control strings; unescape gives it back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that escape was given."""
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """One turn in the template."""
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{CLOSE}"


def read_turn(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    found = _TURN.fullmatch(rendered)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


@dataclass
class Message:
    """The state of one message while its events are folded."""

    conv_id: object
    name: str
    first: int
    role: str = ""
    parts: list[str] = field(default_factory=list)
    gone: bool = False

    def apply(self, event: str, role: str | None, text: str | None) -> None:
        """One event: open, delta, edit, regenerate or delete; others change nothing."""
        if role and not self.role:
            self.role = role
        if event in ("edit", "regenerate"):
            self.parts.clear()
        if event in ("delta", "edit", "open") and text:
            self.parts.append(text)
        if event in ("open", "delta", "edit", "regenerate"):
            self.gone = False
        elif event == "delete":
            self.gone = True


def reconstruct(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, message, event, role, text) -> turns(conv_id, first_seq, message, rendered).

    Events of a message are folded by seq, those with one seq by event name and text. An open or
    delta adds its text, an edit replaces what is there, regenerate starts anew, delete takes the
    message away until it is opened again. The first role given holds; without one it is empty.
    Null texts are empty; rows with a null message or seq are ignored; an empty log gives no turns.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Message | None = None

        def turn(m: Message) -> tuple:
            return m.conv_id, m.first, m.name, render(m.role, "".join(m.parts))

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in slices(batches):
            done = []
            for conv, seq, name, event, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or (now.conv_id, now.name) != (conv, name):
                    if now is not None and not now.gone:
                        done.append(turn(now))
                    now = Message(conv, name, seq)
                now.apply(event, role, text)
            yield rows(done)
        if now is not None and not now.gone:
            yield rows([turn(now)])

    names, types = ["conv_id", "first_seq", "message", "rendered"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message").cast("string").alias("message"), "event", "role", "text")
    log = log.filter("message is not null and seq is not null").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "event", "text")
    return log.mapInArrow(folded, "conv_id long, first_seq long, message string, rendered string")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its rendered turns in order: counts and digests.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Digests need the
    turns of a conversation one after another; they pass through one task, but none are kept.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = None
        open_ = False
        count = loss_chars = chars = 0
        turns_hash = loss_hash = hashlib.sha256()

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([],) * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in slices(batches):
            done = []
            for this, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not open_ or this != conv:
                    if open_:
                        done.append((conv, count, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
                    conv, open_, count, loss_chars, chars = this, True, 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(rendered)
                count += 1
                chars += len(rendered)
                turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if role in LEARNED_ROLES:
                    loss_chars += len(text)
                    loss_hash.update(text.encode("utf-8", "replace"))
            yield rows(done)
        if open_:
            yield rows([(conv, count, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars)])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "message")
    return ordered.select("conv_id", "rendered").mapInArrow(
        digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
