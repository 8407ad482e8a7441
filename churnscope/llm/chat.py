"""Chat formatting with a grammar round trip.

Template: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Grammar read by ``parse``::

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>\\n" }
    role         = characters other than newline, backslash written as "\\\\", newline as "\\n"
    text         = shortest stretch up to "<|im_end|>", without "<|im_start|>"; "<\\|im_...|>" loses one backslash

``render`` writes a conversation raw, parses the result, compares the turns with the source and escapes those texts that
did not come back: each control string, and each already escaped one, gets one more backslash after its ``<``. It repeats
until the parsed turns are identical (two rounds at most, as an escaped text holds no control string). Nothing but
conflicting texts is changed. The loss mask covers the stretches of assistant texts as rendered; escape backslashes
inside them are taken out again when the masked text is read.

A conversation is one training example, rendered whole: rows are hash partitioned by conversation and sorted by turn,
and a task streams over them holding one conversation at a time.

Edge cases: null text is empty, a null role is an empty role; rows of equal (conversation, turn) are ordered by role and
text; null turns come first; a null conv_id is a conversation of its own key; repeated rows are repeated turns; an empty
table gives only the extra turns passed in; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")


class GrammarError(ValueError):
    """The text is not a rendered conversation."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def _write_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p")


def _read_role(role: str) -> str:
    out = re.sub(r"\\([\\np])", lambda m: {"\\": "\\", "n": "\n", "p": "|"}[m[1]], role)
    return out


def parse_one(rendered: str, at: int):
    """(role, text, start and end of the text, next position) of the turn that begins at ``at``."""
    if not rendered.startswith(START, at):
        raise GrammarError(f"no turn at {at}")
    line = rendered.find("\n", at)
    begin = line + 1
    end = rendered.find(END, begin)
    if line < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
        raise GrammarError(f"open turn at {at}")
    body = rendered[begin:end]
    if START in body:
        raise GrammarError(f"turn inside the turn at {at}")
    return _read_role(rendered[at + len(START):line]), unescape(body), begin, end, end + len(END) + 1


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a rendered conversation; GrammarError if it is none."""
    out, at = [], 0
    while at < len(rendered):
        role, text, _, _, at = parse_one(rendered, at)
        out.append((role, text))
    return out


def _write(role: str, body: str) -> str:
    return f"{START}{_write_role(role)}\n{body}{END}\n"


def _returns(role: str, text: str, body: str) -> bool:
    written = _write(role, body)
    try:
        r, t, _, _, end = parse_one(written, 0)
    except GrammarError:
        return False
    return (r, t, end) == (role, text, len(written))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(rendered text, loss spans in it); the rendered text parses back to exactly ``turns``."""
    bodies = [text for _, text in turns]
    conflicting = [i for i, (r, t) in enumerate(turns) if not _returns(r, t, bodies[i])]
    while conflicting:
        for i in conflicting:
            bodies[i] = escape(turns[i][1])
        conflicting = [i for i in conflicting if not _returns(*turns[i], bodies[i])]
    out, spans, at = [], [], 0
    for (role, _), body in zip(turns, bodies, strict=True):
        piece = _write(role, body)
        if role == LOSS_ROLE:
            begin = at + len(piece) - len(body) - len(END) - 1
            spans.append((begin, begin + len(body)))
        out.append(piece)
        at += len(piece)
    rendered = "".join(out)
    if parse(rendered) != list(turns):
        raise GrammarError("the rendered conversation does not read back")
    return rendered, spans


FORMAT_SCHEMA = "conv_id long, formatted string, loss_start array<long>, loss_end array<long>"


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end (code points): one row per conversation of (conv_id, turn, role, text)."""
    def task(batches):
        def flush(key, rows):
            text, spans = render(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([text], pa.string()),
                 pa.array([[a for a, _ in spans]], pa.list_(pa.int64())),
                 pa.array([[b for _, b in spans]], pa.list_(pa.int64()))],
                names=["conv_id", "formatted", "loss_start", "loss_end"])

        key, rows, ready = None, [], []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and conv != key:
                    ready.append(flush(key, rows))
                    rows = []
                    if len(ready) >= 500:
                        yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                        ready = []
                key = conv
                rows.append((role, text))
        if rows:
            ready.append(flush(key, rows))
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]

    rows = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text"))
    return rows.mapInArrow(task, FORMAT_SCHEMA)


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """Turns, loss text and length of every formatted conversation, read back by the parser."""
    def task(batches):
        for batch in batches:
            out = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                told = hashlib.sha256()
                for role, body in turns:
                    told.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                out.append((conv, len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                            len(text)))
            names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(kinds))],
                                             names=names)

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(task, DIGEST_SCHEMA)
