"""Chat formatting with a grammar round trip.

A turn is rendered as opener, text and closer of its role. The rendering is
parsed back by a deterministic parser (it reads an opener, then text without any
control string up to the closer, and takes a backslash as a mark that the next
character is plain), and the turn that comes out is compared with the source. If
they differ, the text holds something that conflicts with the grammar: control
strings are then broken by a mark and backslashes marked, part by part, until
the parser gives the very turn. No text thus holds a control string. A rendered
turn starts and ends in the parser's outer state, so a conversation parses as
its turns do, and turns are rendered where they lie, without a shuffle.

Conversations are put in order by one shuffle and a sort; offsets and digests
are carried along in a stream, so a conversation of any length is never held.

Defined results: null text is empty; a null role is written as an unnamed one
and is empty in digests; null ids are one conversation; turns with equal numbers
come by role and text; repeated rows are repeated turns; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

# role -> what opens and closes its turns; other roles are named inside NAMED
ROLES = {
    "system": ("<s>[SYS] ", " [/SYS]\n"),
    "user": ("<s>[INST] ", " [/INST]\n"),
    "assistant": ("<s>[OUT] ", " </s>\n"),
}
NAMED, NAME_ENDS, NAMED_ENDS = "<s>[ROLE] ", " [NAME] ", " [/ROLE]\n"
LOSS_ROLE = "assistant"
MARK = "\\"
CONTROL = re.compile(r"</?s>|\[/?(?:SYS|INST|ROLE)\]|\[(?:OUT|NAME)\]|\\")
OPENERS = [(opener, role, closer) for role, (opener, closer) in ROLES.items()]


def mark_all(text: str) -> str:
    """Every control string broken by a mark after its first character, every backslash marked."""
    return CONTROL.sub(lambda m: m[0][0] + MARK + m[0][1:] if m[0] != MARK else MARK + MARK, text)


def _read(data: str, at: int, closer: str) -> tuple[str, int] | None:
    """Text from ``at`` up to the closer, marks taken off, and the place after the closer.

    None if a control string other than the closer comes first, or none at all.
    """
    out = []
    while True:
        m = CONTROL.search(data, at)
        if m is None:
            return None
        if m[0] == MARK:
            out.append(data[at:m.start()] + data[m.end():m.end() + 1])
            at = m.end() + 1
            continue
        end = m.start() - 1  # closers begin with a space
        if end < at or not data.startswith(closer, end):
            return None
        out.append(data[at:end])
        return "".join(out), end + len(closer)


def parse(data: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, start and end of the text as rendered); None if it is not of the grammar."""
    turns, at = [], 0
    while at < len(data):
        for opener, role, closer in OPENERS:
            if data.startswith(opener, at):
                start = at + len(opener)
                break
        else:
            named = _read(data, at + len(NAMED), NAME_ENDS) if data.startswith(NAMED, at) else None
            if named is None:
                return None
            (role, start), closer = named, NAMED_ENDS
        got = _read(data, start, closer)
        if got is None:
            return None
        text, at = got
        turns.append((role, text, start, at - len(closer)))
    return turns


def render_turn(role: str | None, text: str | None) -> str:
    """A turn as text; marks are set only where the round trip asks for them."""
    role, text = role or "", text or ""
    want = [(role, text)]
    for named, body in ((role, text), (role, mark_all(text)), (mark_all(role), text), (mark_all(role), mark_all(text))):
        if role in ROLES:
            opener, closer = ROLES[role]
            data = opener + body + closer
        else:
            data = NAMED + named + NAME_ENDS + body + NAMED_ENDS
        turns = parse(data)
        if turns is not None and [t[:2] for t in turns] == want:
            return data
    raise ValueError("a turn does not survive its round trip")


def format_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, turn, role, text, segment) per turn: ``segment`` is the turn as rendered."""
    small_batches(turns.sparkSession)
    kinds = {new: turns.schema[old].dataType.simpleString() for new, old in (("id", id_col), ("turn", turn_col))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = [render_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segments, pa.string())], names=["id", "turn", "role", "text", "segment"])

    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kinds['id']}, turn {kinds['turn']}, role string, text string, segment string")


def _ordered(segments: DataFrame) -> DataFrame:
    rows = segments.select("id", "turn", "role", "text", "segment")
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "segment")


def loss_spans(segments: DataFrame) -> DataFrame:
    """(id, segment, start, loss_start, loss_end) per turn in order: its place in the conversation's text and the span the loss counts.

    Spans are in code points of the whole conversation and null where the loss
    counts nothing.
    """
    kind = segments.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = (), 0
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, s in zip(ids, b.column(1).to_pylist()):
                if (i,) != last:
                    last, at = (i,), 0
                role, _, start, end = parse(s)[0]
                counts = role == LOSS_ROLE
                out.append((at, at + start if counts else None, at + end if counts else None))
                at += len(s)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in zip(*out)]], names=["id", "segment", "start", "loss_start", "loss_end"])

    return _ordered(segments).mapInArrow(run, f"id {kind}, segment string, start bigint, loss_start bigint, loss_end bigint")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation of what the parser reads from its text.

    Gives id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    kind = segments.schema["id"].dataType
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = (), None, []

        def told(id_kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*done), (id_kind, *kinds))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def end() -> None:
            if state:
                n, turns, chars, loss, size = state
                done.append((last[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        id_kind = None
        for b in batches:
            id_kind = b.column(0).type
            for i, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (i,) != last:
                    end()
                    last, state = (i,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, start, stop in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        counted = _read(segment[start:stop] + ROLES[role][1], 0, ROLES[role][1])[0]
                        state[2] += len(counted)
                        state[3].update(counted.encode())
                state[4] += len(segment)
            if len(done) > 1000:
                yield told(id_kind)
        end()
        if done:
            yield told(id_kind)

    schema = f"id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _ordered(segments).mapInArrow(run, schema)


def conversations(segments: DataFrame) -> DataFrame:
    """(id, text) of whole conversations, for those that fit a row."""
    part = F.struct("turn", "role", "text", "segment")
    whole = segments.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select("id", F.array_join(F.col("parts.segment"), "").alias("text"))
