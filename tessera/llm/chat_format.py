"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. A deterministic
parser reads rendered text back. Each turn is rendered plainly first; if what the parser recovers is not the source,
the content that conflicts is escaped and the turn is rendered and parsed again, until both are identical. The last
resort escapes every opening mark, after which the text cannot hold a control string.

Grammar: ``<|esc|>`` stands for ``<|`` and ``<|nl|>`` (in roles only) for a line feed.

Turns are rendered one by one where they lie. Conversations then meet in one shuffle and are read in order, turn by
turn, so a long conversation needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

# The control strings of the template.
START, END, ESCAPE, LINE = "<|im_start|>", "<|im_end|>", "<|esc|>", "<|nl|>"
OPEN = "<|"
LOSS_ROLE = "assistant"
_CONTROL = regex.compile("|".join(map(regex.escape, (START, END, ESCAPE, LINE))))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, first, last) of each turn, where [first, last) is the text's span in ``formatted``; None if it is
    not in the grammar."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        line = formatted.find("\n", at)
        end = formatted.find(END, at)
        if line < 0 or end < line or not formatted.startswith("\n", end + len(END)):
            return None
        role, body = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in role or START in body or LINE in body:
            return None
        out.append((role.replace(LINE, "\n").replace(ESCAPE, OPEN), body.replace(ESCAPE, OPEN), line + 1, end))
        at = end + len(END) + 1
    return out


def _escape_conflicts(s: str, is_role: bool) -> str:
    """The control strings in ``s`` with their opening mark escaped."""
    out = _CONTROL.sub(lambda m: ESCAPE + m[0][len(OPEN) :], s)
    return out.replace("\n", LINE) if is_role else out


def _escape_all(s: str, is_role: bool) -> str:
    out = s.replace(OPEN, ESCAPE)
    return out.replace("\n", LINE) if is_role else out


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The rendered turn, the span of its text, and the level of escaping (0 none, 1 conflicts, 2 every opening mark)
    that the round trip needed."""
    for level, escape in enumerate((lambda s, _: s, _escape_conflicts, _escape_all)):
        formatted = render(escape(role, True), escape(text, False))
        turns = parse(formatted)
        if turns is not None and len(turns) == 1 and turns[0][:2] == (role, text):
            return formatted, turns[0][2], turns[0][3], level
    raise AssertionError("escaping every opening mark is always reversible")


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, formatted, loss_from, loss_to, level`` for every turn.

    The text of an assistant's turn is under the loss mask: code points [loss_from, loss_to) of ``formatted``; both
    are 0 for other roles. Null roles and texts count as empty.
    """
    names = ["conv_id", "turn", "role", "formatted", "loss_from", "loss_to", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                formatted, first, last, level = format_turn(role, text)
                made.append((formatted, first, last, level) if role == LOSS_ROLE else (formatted, 0, 0, level))
            cols = list(zip(*made, strict=True)) if made else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    src = rows.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), text_or_empty(F.col(role_col)).alias("role"), text_or_empty(F.col(text_col)).alias("text"))
    return src.mapInArrow(run, "conv_id bigint, turn bigint, role string, formatted string, loss_from bigint, loss_to bigint, level bigint")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped_turns`` for each conversation.

    Read back from what :func:`format_turns` returns: every turn is parsed again and its loss span unescaped. Turns go
    by turn number; null comes first, and ties by role and then formatted text. A null conv_id is a conversation of
    its own.
    """
    order = ["conv_id", "turn", "role", "formatted"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            conv, n, turns_sha, loss, loss_sha, chars, escaped = state
            done.append((conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars, escaped))

        for batch in batches:
            for conv, formatted, first, last, level in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to", "level")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                masked = formatted[first:last].replace(ESCAPE, OPEN)
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(formatted)
                state[6] += level > 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    placed = turns.repartition("conv_id").sortWithinPartitions(*order).select(*order, "loss_from", "loss_to", "level")
    return placed.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, escaped_turns bigint")
