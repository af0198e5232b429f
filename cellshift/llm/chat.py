"""Chat formatting with a grammar that round-trips: render, reparse, and escape until the turns come back.

A turn is written as ``<turn role>`` newline, the text, newline, ``</turn>`` newline. The parser is a push parser over
lines. A text whose plain form doesn't come back as exactly one equal turn is escaped: every line that starts with a
control string (``<turn `` or ``</turn>``), with any number of backslashes before it, gets one backslash more; the
parser takes one off. Turns of one conversation are streamed in order through one task with constant state, so
a conversation of any length is neither collected nor cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

OPEN, CLOSE = "<turn ", "</turn>"
#: A line's leading backslashes before a control string; with one backslash more, the line is text.
_CONTROL = re.compile(r"(?:\A|(?<=\n))(?=\\*(?:<turn |</turn>))")
_ESCAPED = re.compile(r"(?:\A|(?<=\n))\\(?=\\*(?:<turn |</turn>))")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str


class Parser:
    """Deterministic parser of rendered text, fed piece by piece; a piece ends with a newline.

    A role is percent-coded where it has a character that would end it. Anything outside a turn is an error.
    """

    def __init__(self):
        self.role: str | None = None
        self.lines: list[str] = []

    def feed(self, rendered: str) -> Iterator[Turn]:
        for line in rendered.split("\n")[:-1]:
            if self.role is None:
                if not (line.startswith(OPEN) and line.endswith(">")):
                    raise ValueError(f"not the start of a turn: {line[:40]!r}")
                self.role, self.lines = _plain(line[len(OPEN) : -1]), []
            elif line == CLOSE:
                yield Turn(self.role, unescape("\n".join(self.lines)))
                self.role = None
            elif line.startswith(OPEN):
                raise ValueError("a turn starts inside a turn")
            else:
                self.lines.append(line)

    @property
    def open(self) -> bool:
        return self.role is not None


def _coded(role: str) -> str:
    return re.sub(r"[%>\n]", lambda m: f"%{ord(m[0]):02x}", role)


def _plain(role: str) -> str:
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def _reads_back(rendered: str, turn: Turn) -> bool:
    parser = Parser()
    try:
        return list(parser.feed(rendered)) == [turn] and not parser.open
    except ValueError:
        return False


def render(turn: Turn) -> str:
    """The turn in the plain form if it parses back to itself, else with its control strings escaped."""
    head = f"{OPEN}{_coded(turn.role)}>\n"
    for text in (turn.text, escape(turn.text)):
        rendered = f"{head}{text}\n{CLOSE}\n"
        if _reads_back(rendered, turn):
            return rendered
    raise AssertionError("an escaped turn must parse back")


def formatted(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn: (conv, turn, at, rendered, loss_from, loss_to), ``at`` counting a conversation's rows from 0.

    ``rendered`` of a conversation's rows by ``at``, joined, is its training text; characters loss_from:loss_to of a row carry
    the loss (NULL for other roles). NULL text or role counts as empty; turns that tie are put in order of role and text;
    NULL turns come first; rows with a NULL conversation form one conversation. Other columns are not used.
    """
    shape = StructType([
        StructField(conv, turns.schema[conv].dataType), StructField(turn, turns.schema[turn].dataType),
        StructField("at", LongType()), StructField("rendered", StringType()), StructField("loss_from", LongType()), StructField("loss_to", LongType())])

    def write(batches):
        last, count = (), 0
        for b in batches:
            at, out, begin, end = [], [], [], []
            for c, r, t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                last, count = (c,), count + 1 if last == (c,) else 0
                at.append(count)
                out.append(render(Turn(r, t)))
                head = len(OPEN) + len(_coded(r)) + 2
                mine = r in learn
                begin.append(head if mine else None)
                end.append(len(out[-1]) - len(CLOSE) - 2 if mine else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.int64()), pa.array(out, pa.string()), pa.array(begin, pa.int64()),
                 pa.array(end, pa.int64())], names=shape.names)

    filled = turns.select(
        F.col(conv), F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = [F.col(conv).asc_nulls_first(), F.col(turn).asc_nulls_first(), "_role", "_text"]
    return filled.repartition(F.col(conv)).sortWithinPartitions(*order).mapInArrow(write, shape)


def read_back(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest of each conversation from its rendered rows, as ``formatted`` gives them.

    (conv, n_turns, turns_sha256 over role, newline, text, newline of each turn, loss_chars and loss_sha256 of all text
    under the loss mask, unescaped, and formatted_chars). Rows are parsed in a stream; text outside a turn raises.
    """
    kind = rendered.schema[conv].dataType
    shape = StructType([StructField(conv, kind), *StructType().add("n_turns", "long").add("turns_sha256", "string").add(
        "loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")])

    def digest(batches):
        current, state = None, None

        def row():
            if state["parser"].open:
                raise ValueError("a conversation ends inside a turn")
            return (current[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"])

        for b in batches:
            done = []
            for c, r, i, j in zip(*(b.column(k).to_pylist() for k in range(4))):
                if current is None or current[0] != c:
                    if current is not None:
                        done.append(row())
                    current = (c,)
                    state = {"parser": Parser(), "n": 0, "chars": 0, "all": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for t in state["parser"].feed(r):
                    state["n"] += 1
                    state["turns"].update(f"{t.role}\n{t.text}\n".encode())
                if i is not None:
                    learned = unescape(r[i:j])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["all"] += len(r)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, d)) for d in done], schema=arrow)
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, row()))], schema=arrow)

    arrow = to_arrow_schema(shape)
    rows = rendered.select(conv, "rendered", "loss_from", "loss_to", "at")
    return rows.repartition(F.col(conv)).sortWithinPartitions(F.col(conv).asc_nulls_first(), "at").mapInArrow(digest, shape)
