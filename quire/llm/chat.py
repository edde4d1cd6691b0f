"""Chat formatting with a grammar round trip.

A turn is rendered as

    ### <role>: <text> </turn>\n

in which a role or text never holds a bare control string: `###`, `</turn>`
and, in a role, `: `. A backslash before a control string or before another
backslash is taken away by the parser. Most texts need no escaping, so each is
first rendered as it is, parsed again and compared with its source; only what
does not come back identical is escaped, first its control strings and then
its backslashes too, until it does. The last form is always reversible.

Nulls: a null role or text is empty. Rows with a null conv_id form one
conversation; null turns come first. Ties in turn are ordered by role and
text, and repeated rows stay repeated. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions, sliced

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LEVELS = 3
_CONTROL = {"role": re.compile(r"###|</turn>|:|\n"), "text": re.compile(r"###|</turn>")}
_BOTH = {"role": re.compile(r"\\|###|</turn>|:|\n"), "text": re.compile(r"\\|###|</turn>")}
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
_ITEM = re.compile(r"\\(?:\\|###|</turn>|:|\n)|###|</turn>|:|\n")


def escape(value: str, part: str, level: int) -> str:
    """Level 0: as it is; 1: control strings; 2: backslashes too."""
    if level == 0:
        return value
    return (_CONTROL if level == 1 else _BOTH)[part].sub(lambda m: "\\" + m[0], value)


def unescape(value: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], value)


def render_turn(role: str, text: str, role_level: int, text_level: int) -> str:
    return f"{OPEN}{escape(role, 'role', role_level)}{MIDDLE}{escape(text, 'text', text_level)}{CLOSE}"


def parse(rendered: str, start: int = 0) -> list[tuple[str, str, int, int]]:
    """All turns of a rendered text: (role, text, and where the text stands in the rendered text).

    One pass from left to right; anything that is not a sequence of whole
    turns raises ValueError.
    """
    out, at = [], start
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        at += len(OPEN)
        head = at
        while True:
            m = _ITEM.search(rendered, at)
            if m is None:
                raise ValueError("the role does not end")
            at = m.end()
            if m[0] == ":":
                break
            if m[0][0] != "\\":
                raise ValueError(f"control string in a role at {m.start()}")
        if not rendered.startswith(MIDDLE, at - 1):
            raise ValueError(f"no space after the role at {at}")
        role, at = unescape(rendered[head : at - 1]), at - 1 + len(MIDDLE)
        body = at
        while True:
            m = _ITEM.search(rendered, at)
            if m is None:
                raise ValueError("the turn does not end")
            at = m.end()
            if m[0] == "</turn>":
                break
            if m[0] == "###":
                raise ValueError(f"control string in a text at {m.start()}")
        end = m.start() - 1
        if end < body or rendered[end] != " " or rendered[at : at + 1] != "\n":
            raise ValueError(f"a turn ends badly at {end}")
        out.append((role, unescape(rendered[body:end]), body, end))
        at += 1
    return out


def render(role: str | None, text: str | None) -> tuple[str, int, int, int]:
    """The lightest rendering that parses back to exactly this turn: (rendered, body start, body end, escape levels used)."""
    role, text = role or "", text or ""
    for level in range(LEVELS * LEVELS):
        role_level, text_level = level // LEVELS, level % LEVELS
        rendered = render_turn(role, text, role_level, text_level)
        try:
            turns = parse(rendered)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3], level
    raise AssertionError("the last level is reversible")


def _render_batches(batches):
    for batch in sliced(batches):
        conv, turn, role, text = (batch.column(i) for i in range(4))
        done = [render(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                conv, turn,
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
                pa.array([r == "assistant" for r in role.to_pylist()], pa.bool_()),
                pa.array([d[3] for d in done], pa.int32()),
            ],
            names=["conv_id", "turn", "formatted", "body_start", "body_end", "in_loss", "escape_level"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """One formatted string for each turn; the conversation is their concatenation in turn order.

    body_start and body_end say where the text stands in the formatted string
    (code points); in_loss, whether that span counts for the loss. No shuffle:
    a conversation of any length is never gathered.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        _render_batches,
        "conv_id long, turn long, formatted string, body_start long, body_end long, in_loss boolean, escape_level int",
    )


class _Reader:
    """Running digests of one conversation, read from its formatted turns."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, in_loss: bool) -> None:
        """A formatted turn, and the span of it that the loss mask names."""
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if in_loss:
            text = unescape(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self):
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _read_batches(batches):
    """Sorted turns in, a row for each conversation out; holds one turn and two digests at a time."""
    now, rows = None, []
    for batch in batches:
        for conv, *turn in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if now is None or conv != now.conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Reader(conv)
            now.add(*turn)
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
            rows = []
    if now is not None:
        rows.append(now.row())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def _part(start, length):
    """A part of the formatted turn as it was before it was escaped."""
    return F.regexp_replace(F.substr(F.col("formatted"), start, length), r"\\(\\|###|</turn>|:|\n)", "$1")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests for each conversation, from its formatted turns in order and their loss mask.

    Turns are parsed from the formatted text alone; what counts for the loss is
    the span that body_start, body_end and in_loss name. Ties in turn go by the
    role and text that the formatted turn holds. A digest runs over a
    conversation from its first turn to its last, so one task must pass over
    it; it streams, and the sort before it spills.
    """
    n = partitions(formatted.sparkSession)
    role = _part(F.lit(len(OPEN) + 1), (F.col("body_start") - len(OPEN) - len(MIDDLE)).cast("int"))
    text = _part((F.col("body_start") + 1).cast("int"), (F.col("body_end") - F.col("body_start")).cast("int"))
    return (
        formatted.select("conv_id", "turn", "formatted", "body_start", "body_end", "in_loss")
        .repartition(n, "conv_id")
        .sortWithinPartitions(F.col("conv_id"), F.col("turn"), role, text)
        .select("conv_id", "formatted", "body_start", "body_end", "in_loss")
        .mapInArrow(_read_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def op9_grammar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7."""
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(rows.unionByName(extra)))
