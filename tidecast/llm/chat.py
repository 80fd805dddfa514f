r"""Chat formatting with a grammar round trip (operator 3).

Grammar of the rendered text, one turn after the other::

    turn      := "<s>[INST] " text " [/INST]"            user
               | "<s>[SYS] " text " [/SYS]"              system
               | "<s>[OUT] " text " </s>"                assistant
               | "<s>[ROLE " name "] " text " [/ROLE]"   any other role ("<s>[NULL] " text " [/NULL]" for none)
    escape    := "\" char                                stands for char, where char is one of  \ < [ ]

The parser is deterministic: it reads an opening mark, then text up to the first unescaped closing mark of that turn, and
takes escapes off. A turn is rendered plainly first and reparsed in its place; where the recovered turn differs from
the source, the control strings in it are escaped, and if that is not enough (a text with backslashes of its own), every
special character. The last level always gives the turn back. The escape level chosen is part of the result.

Defined results: a null text is an empty one; a null role is kept apart from every name; rows of one conversation are
ordered by turn (null first), then role, then text, and every row is a turn, repeated rows too; conversations with a null
id form one conversation; other columns are not read; an empty table gives an empty result.

Formatting is narrow. Digests of a conversation need its turns in order, so rows are dealt by conversation and sorted
there, and a stream of turns updates running hashes: a task holds one turn at a time, however long a conversation is. A hash
over a sequence cannot be split, so one conversation is always read by one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import map_batches, query, scan

#: Fixed format: opening and closing marks by role.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s>[SYS] ", " [/SYS]"), "assistant": ("<s>[OUT] ", " </s>"), None: ("<s>[NULL] ", " [/NULL]")}
OPEN_ROLE, CLOSE_ROLE = "<s>[ROLE ", " [/ROLE]"
SPECIAL = re.compile(r"[\\<\[\]]")
CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?(?:INST|SYS|OUT|ROLE|NULL)\b)|\\(?=[\\<\[\]])")
ESCAPED = re.compile(r"\\([\\<\[\]])")
LOSS_ROLE = "assistant"


class BadTurn(ValueError):
    """The text does not follow the grammar."""


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    return (CONTROL if level == 1 else SPECIAL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def rendered(role: str | None, text: str, level: int) -> tuple[str, int, int]:
    """A turn and where its text lies in it."""
    if role in MARKS:
        begin, end = MARKS[role]
    else:
        begin, end = f"{OPEN_ROLE}{escape(role, 2)}] ", CLOSE_ROLE
    body = escape(text, level)
    return begin + body + end, len(begin), len(begin) + len(body)


def free_at(text: str, mark: str, at: int) -> int:
    """First place of ``mark`` from ``at`` on whose special character is not escaped."""
    inner = 1 if mark[0] == " " else 0
    while (found := text.find(mark, at)) >= 0:
        k = found + inner
        slashes = k
        while slashes > 0 and text[slashes - 1] == "\\":
            slashes -= 1
        if (k - slashes) % 2 == 0:
            return found
        at = found + 1
    raise BadTurn(mark)


def parse(text: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, begin, end) of every turn; begin and end enclose the escaped text."""
    out, at = [], 0
    while at < len(text):
        for role, (begin, end) in MARKS.items():
            if text.startswith(begin, at):
                start = at + len(begin)
                break
        else:
            if not text.startswith(OPEN_ROLE, at):
                raise BadTurn(text[at:at + 20])
            stop = free_at(text, "] ", at + len(OPEN_ROLE))
            role, start, end = unescape(text[at + len(OPEN_ROLE):stop]), stop + 2, CLOSE_ROLE
        stop = free_at(text, end, start)
        out.append((role, unescape(text[start:stop]), start, stop))
        at = stop + len(end)
    return out


def format_turn(role: str | None, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, text begin, text end, escape level): the lowest level that parses back to the source."""
    for level in range(3):
        out, begin, end = rendered(role, text, level)
        try:
            if parse(out) == [(role, text, begin, end)]:
                return out, begin, end, level
        except BadTurn:
            pass
    raise BadTurn(f"role {role!r} cannot be rendered")


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, segment, text_begin, text_end, escape_level); a conversation's rendered text is its segments in order,
    and the loss mask of a segment covers text_begin to text_end where the role is the assistant's."""
    def run(batch: pa.RecordBatch) -> list:
        made = [format_turn(r, t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        seg, begin, end, level = zip(*made)
        return [*batch.columns, pa.array(seg, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(level, pa.int32())]

    kinds = dict(df.dtypes)
    return map_batches(df.select("conv_id", "turn", "role", "text"), run,
                       f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, segment string, "
                       "text_begin bigint, text_end bigint, escape_level int")


class Digest:
    """Running digests of one conversation, read back from its rendered segments."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.escaped = 0

    def add(self, segment: str, level: int) -> None:
        for role, text, begin, end in parse(segment):
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            self.n_turns += 1
            if role == LOSS_ROLE:
                span = unescape(segment[begin:end])
                self.loss.update(span.encode())
                self.loss_chars += len(span)
        self.chars += len(segment)
        self.escaped += level > 0

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.escaped)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone."""
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"]

    def run(batches):
        types = None
        now, begun, done = None, False, []
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for conv, segment, level in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not begun or conv != now.conv_id:
                    if begun:
                        done.append(now.row())
                    now, begun = Digest(conv), True
                now.add(segment, level)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), types)], names)
                done = []
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), types)], names)

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "segment", "escape_level")
            .mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                             "formatted_chars bigint, n_escaped bigint"))


@query("op3_chat_format")
def op3_chat_format(spark, folder):
    """Digests of all conversations and of one made of control strings."""
    turns = scan(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], turns.schema)
    return conversation_digests(format_turns(turns.unionByName(planted)))
