"""Chat formatting in budgeted windows.

A conversation becomes one or more formatted windows. Prefix sums of its turns' tokens choose turn-aligned spans: a
window holds the leading system turn, then as many whole turns before the span as the history budget takes, then the
span, as long as the token budget allows (one turn at least, so that a turn beyond the budget has a window of its own).
Loss lies on the texts of assistant turns; in repeated history it is masked, so each target counts once.

Control strings mark turns. Inside texts and role names their first characters are escaped, so a text that holds a
control string comes back unchanged and can never end its turn.

Conversations are streamed from partitions sorted by conversation and turn: a task holds the turns of one window,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import narrow, released
from lumenfold.llm.tokencount import counter

# The marks around a turn's text, by role; all begin with an escaped character.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
INNER = r"((?:[^\\\[\]<]|\\[\\\[\]<])*)"
TURN = re.compile("|".join([*(re.escape(a) + INNER + re.escape(b) for a, b in MARKS.values()), re.escape(OTHER[0]) + INNER + re.escape(OTHER[1]) + INNER + re.escape(OTHER[2])]))


@dataclass(frozen=True)
class Budget:
    """In tokens: of a window, and of the history that it may repeat."""

    window: int = 1024
    history: int = 256


def escape(text: str) -> str:
    return re.sub(r"([\\\[\]<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\\[\]<])", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text begins and ends."""
    before, after = MARKS[role] if role in MARKS else (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end of the escaped text) of each turn, read from a formatted window."""
    at, roles = 0, list(MARKS)
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        known = next((i for i in range(1, len(roles) + 1) if m[i] is not None), None)
        group = known or len(roles) + 2
        yield roles[known - 1] if known else unescape(m[len(roles) + 1]), unescape(m[group]), m.start(group), m.end(group)
        at = m.end()


@dataclass
class Turn:
    role: str
    text: str
    tokens: int
    formatted: str
    begin: int
    end: int


def windows(turns: Iterator[Turn], budget: Budget) -> Iterator[tuple[list[Turn], int]]:
    """(turns, how many of the first of them are repeated) of each window."""
    system: list[Turn] = []
    repeated: list[Turn] = []
    span: list[Turn] = []
    held = 0
    for number, turn in enumerate(turns):
        if number == 0 and turn.role == "system":
            system = [turn]
        elif held + turn.tokens > budget.window and len(span) > (number == len(span)) * len(system):
            yield [*repeated, *span], len(repeated)
            history, total = [], 0
            for old in reversed(span):
                total += old.tokens
                if total > budget.history or any(old is s for s in system):
                    break
                history.insert(0, old)
            kept = sum(t.tokens for t in system)
            while history and kept + sum(t.tokens for t in history) + turn.tokens > budget.window:
                history.pop(0)
            repeated, span = [*system, *history], []
            held = sum(t.tokens for t in repeated)
        span.append(turn)
        held += turn.tokens
    if span:
        yield [*repeated, *span], len(repeated)


FORMATTED = "id {kind}, window int, formatted string, n_turns int, n_repeated int, n_tokens bigint, loss array<struct<begin:int,end:int>>"
SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, its rows) for each run of equal ids; the rows must be used up before the next run."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield from zip(part.column("id").to_pylist(), *[part.column(n).to_pylist() for n in names], strict=True)

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[0]

        def run() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row, ahead = ahead, next(source, None)
                yield row[1:]

        own = run()
        yield key, own
        for _ in own:
            pass


def _formatted(df: DataFrame, names: tuple[str, str, str, str], model: str, budget: Budget, then) -> tuple[DataFrame, Callable]:
    id_col, turn_col, role_col, text_col = names
    source = narrow(df, id=id_col, turn=turn_col, role=role_col, text=text_col)
    filled = source.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    dealt = filled.repartition("id").sortWithinPartitions("id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model, 16_000, 256)

        def turn(role: str, text: str) -> Turn:
            formatted, begin, end = format_turn(role, text)
            return Turn(role, text, own.counts([formatted])[0], formatted, begin, end)

        def formatted() -> Iterator[tuple]:
            for key, rows in _runs(batches, ["role", "text"]):
                for number, (turns, repeated) in enumerate(windows((turn(r, t) for r, t in rows), budget)):
                    at, loss = 0, []
                    for i, t in enumerate(turns):
                        if i >= repeated and t.role == "assistant":
                            loss.append({"begin": at + t.begin, "end": at + t.end})
                        at += len(t.formatted)
                    yield key, number, "".join(t.formatted for t in turns), len(turns), repeated, sum(t.tokens for t in turns), loss

        yield from then(formatted())

    return dealt, run


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


NAMES = ("conv_id", "turn", "role", "text")


def format_chats(df: DataFrame, model: str, *, names: tuple[str, str, str, str] = NAMES, budget: Budget = Budget()) -> DataFrame:
    """Formatted windows: id, window, formatted, n_turns, n_repeated, n_tokens, loss (spans of code points).

    Turns are ordered by turn, nulls first, then by role and text, so ties have a fixed order; repeated rows are turns
    of their own. Null text or role counts as empty; a role without marks of its own is written with its name; rows with
    a null id make up one conversation with a null id. Further columns are not read; an empty table gives no rows.
    """
    kind = df.schema[names[0]].dataType
    arrow = pa.schema([("id", _arrow(kind)), ("window", pa.int32()), ("formatted", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss", SPANS)])
    dealt, run = _formatted(df, names, model, budget, lambda rows: _in_batches(rows, arrow))
    return dealt.mapInArrow(released(run), FORMATTED.format(kind=kind.simpleString())).withColumnRenamed("id", names[0])


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of conversations, from their formatted windows alone: turns by parsing, targets by the loss spans."""
    current, state = None, None

    def done() -> tuple:
        return current[0], state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"]

    for key, window, formatted, _, repeated, _, loss in rows:
        if window == 0:
            if current:
                yield done()
            current, state = (key,), {"turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}
        state["chars"] += len(formatted)
        for number, (role, text, _, _) in enumerate(read_turns(formatted)):
            if number >= repeated:
                state["turns"] += 1
                state["sha"].update(f"{role}\n{text}\n".encode())
        for span in loss:
            target = unescape(formatted[span["begin"] : span["end"]])
            state["loss"] += len(target)
            state["loss_sha"].update(target.encode())
    if current:
        yield done()


def chat_digests(df: DataFrame, model: str, *, names: tuple[str, str, str, str] = NAMES, budget: Budget = Budget()) -> DataFrame:
    """What ``format_chats`` wrote, read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Reads the windows in the task that wrote them, in order, so a conversation's hashes are computed in one pass.
    """
    kind = df.schema[names[0]].dataType
    arrow = pa.schema([("id", _arrow(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    dealt, run = _formatted(df, names, model, budget, lambda rows: _in_batches(read_back(rows), arrow))
    sql = f"id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.mapInArrow(released(run), sql).withColumnRenamed("id", names[0])
