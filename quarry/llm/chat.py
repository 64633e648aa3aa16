r"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Rows of a conversation are dealt to one partition and sorted by turn; the machine then streams through them and
emits one row per text segment with its loss flag, so a conversation of any length is formatted in the memory of
one Arrow batch.  Segments of a conversation, concatenated, are its formatted text.

Control strings inside texts are escaped by backslashes after their first character and read back exactly:
``[INST]`` becomes ``[\INST]``, ``[\INST]`` becomes ``[\\INST]``.

Defined results: a null text is empty; a null role reads as the empty role; a role the template does not know is
written between generic marks; null conv_id forms one conversation; equal turns are ordered by role and text;
a conversation whose turns the machine rejects is formatted all the same, with ``valid`` false on its segments
from there on; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: begin and end of a conversation; for each role its marks, whether its text bears loss, and the roles after
#: which it may stand ("" is the start); marks for any other role; every control string as (first, rest).
TEMPLATE = {
    "begin": "<s>",
    "end": "</s>",
    "roles": {
        "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False, "after": [""]},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False, "after": ["", "system", "assistant"]},
        "assistant": {"open": "[OUT]", "close": "[/OUT]", "loss": True, "after": ["user"]},
    },
    "other": {"open": "[TURN]", "then": "[=]", "close": "[/TURN]"},
    "final": ["assistant"],
}
_CONTROL = [(re.compile(r"<(\\*)(/?s>)"), "<"), (re.compile(r"\[(\\*)(/?(?:SYS|INST|OUT|TURN)\]|=\])"), "[")]
_UNDO = [(re.compile(r"<(\\*)\\(/?s>)"), "<"), (re.compile(r"\[(\\*)\\(/?(?:SYS|INST|OUT|TURN)\]|=\])"), "[")]
SEGMENTS = "conv_id long, seq long, text string, loss boolean, valid boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def escape(text: str) -> str:
    for rx, first in _CONTROL:
        text = rx.sub(lambda m, c=first: f"{c}{m[1]}\\{m[2]}", text)
    return text


def unescape(text: str) -> str:
    for rx, first in _UNDO:
        text = rx.sub(lambda m, c=first: f"{c}{m[1]}{m[2]}", text)
    return text


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows as Python values, whole numbers as such beside nulls too."""
    return zip(*(batch.column(c).to_pylist() for c in names))


def _segments(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    none, roles, other = object(), template["roles"], template["other"]
    conv, state, seq, valid, out = none, "", 0, True, []

    def emit(text: str, loss: bool = False) -> None:
        nonlocal seq
        out.append((conv, seq, text, loss, valid))
        seq += 1

    def finish() -> None:
        nonlocal valid
        valid = valid and state in template["final"]
        emit(template["end"])

    for batch in batches:
        for key, role, text in _rows(batch, "conv_id", "role", "text"):
            if key != conv:
                if conv is not none:
                    finish()
                conv, state, seq, valid = key, "", 0, True
                emit(template["begin"])
            if (rule := roles.get(role)) is not None:
                valid = valid and state in rule["after"]
                emit(rule["open"])
                emit(escape(text), rule["loss"])
                emit(rule["close"])
            else:
                valid = False
                emit(other["open"] + escape(role) + other["then"])
                emit(escape(text))
                emit(other["close"])
            state = role
        if out:
            yield _batch(out, SEGMENTS)
            out = []
    if conv is not none:
        finish()
        yield _batch(out, SEGMENTS)


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of every conversation, in order inside each partition: conv_id, seq, text, loss, valid."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda it: _segments(it, template), SEGMENTS)


class _Reader:
    """Reads one conversation's formatted text back, turn by turn."""

    def __init__(self, template: dict) -> None:
        self.template, self.buffer, self.began = template, "", False
        self.n, self.chars, self.loss_chars = 0, 0, 0
        self.turns, self.loss, self.valid = hashlib.sha256(), hashlib.sha256(), True
        self.marks = {r["open"]: (name, r["close"]) for name, r in template["roles"].items()}

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer += text
        while self.turn():
            pass

    def turn(self) -> bool:
        begin, end, other = self.template["begin"], self.template["end"], self.template["other"]
        if not self.began:
            if not self.buffer.startswith(begin):
                return False
            self.buffer, self.began = self.buffer[len(begin) :], True
        if self.buffer.startswith(other["open"]) and (cut := self.buffer.find(other["then"])) >= 0:
            role, start, close = unescape(self.buffer[len(other["open"]) : cut]), cut + len(other["then"]), other["close"]
        elif mark := next((m for m in self.marks if self.buffer.startswith(m)), None):
            (role, close), start = self.marks[mark], len(mark)
        else:
            return False
        stop = self.buffer.find(close, start)
        if stop < 0:
            return False
        self.turns.update(f"{role}\n{unescape(self.buffer[start:stop])}\n".encode())
        self.n += 1
        self.buffer = self.buffer[stop + len(close) :]
        return True

    def row(self, conv: int | None) -> tuple:
        if self.buffer != self.template["end"]:
            raise ValueError(f"conversation {conv} does not read back: {self.buffer[:80]!r}")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, bool(self.valid)


def _digests(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, reader, out = none, _Reader(template), []
    for batch in batches:
        for key, text, loss, valid in _rows(batch, "conv_id", "text", "loss", "valid"):
            if key != conv:
                if conv is not none:
                    out.append(reader.row(conv))
                conv, reader = key, _Reader(template)
            reader.feed(text, loss, valid)
        if out:
            yield _batch(out, DIGESTS)
            out = []
    if conv is not none:
        yield _batch([reader.row(conv)], DIGESTS)


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of each conversation, parsed from its formatted text.

    ``segments`` must come straight from format_conversations, whose partitions hold whole conversations in order.
    """
    return segments.mapInArrow(lambda it: _digests(it, template), DIGESTS)


def chat_digests(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The table and conversation -1, whose two texts are made of control strings."""
    turns = turns.select("conv_id", "turn", "role", "text")
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    probe = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe), template), template)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prior,
  lead(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS following,
  CASE WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 11 ELSE 16 + length(role) END
  + length(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*(/?(?:SYS|INST|OUT|TURN)\]|=\])')) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prior = '' WHEN 'user' THEN prior IN ('', 'system', 'assistant') WHEN 'assistant' THEN prior = 'user' ELSE false END
    AND (following <> '' OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id
"""
