"""Chat formatting in budgeted windows.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Within role and text, ``<``,
any backslashes and ``|`` get one more backslash, so no control string is left
in them; taking it away again restores them. (A role's line breaks are
escaped too.)

The turns of a conversation are cut into windows whose tokens fit
``BUDGET``. A turn costs what its rendered form does, marks and escapes
included; a turn ends in a line break and the next begins with ``<``, so these
add up to the tokens of the window's text. Prefix sums of them say where the
next window must begin, always at a turn. A window repeats the conversation's
system turn and as many whole turns before it as fit ``HISTORY`` tokens. The
loss mask holds the texts of the assistant turns that are new in a window;
repeated ones are masked out, so each is learnt once. A turn that alone exceeds
the budget is a window of its own, with no history, marked ``over_budget``.

Turns are measured where they are read, in any task. A conversation is a stream
in its order (a digest of it is sequential): rows are dealt by conversation,
sorted, and read through with the state of one window, which only adds up and
renders; no conversation is ever held whole.

Edge cases: a null text or role is empty; turns of the same number are ordered
by role and text, null numbers first; repeated rows are turns of their own;
null conversation ids are one conversation; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.bpe import encoder
from searchloom.llm.common import pick, scratch_path

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
#: Tokens of the marks of a turn where a count leaves them out and they are special tokens.
MARKS = 4
_MEASURED = ["conv_id", "turn", "role", "text", "cost"]
#: Turns that are measured together.
_TURNS = 1024
_WINDOWS = (
    "conv_id long, window long, text string, n_turns long, n_repeated long, n_tokens long, "
    "loss_starts array<long>, loss_ends array<long>, over_budget boolean"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def windows_of(turns, count, budget: int = BUDGET, history: int = HISTORY, marks: int = MARKS):
    """Windows of one conversation, from an iterator of ``(role, text)``:
    ``(system and repeated turns, new turns, tokens)``; the system turn is new in
    the first. count: tokens of a turn; marks: those of its marks that count leaves out."""
    system: list = []
    system_cost = 0
    before: deque = deque()  # turns that may be repeated: (prefix sum before, turn)
    prefix = 0  # tokens of all turns so far but the system turn
    repeated: list = []
    new: list = []
    start = 0  # prefix sum before the window's first turn, repeated ones included
    first = True
    for role, text in turns:
        cost = count(role, text) + marks
        if not new and not before and not system and role == "system":
            system, system_cost = [(role, text)], cost
            continue
        if new and system_cost + prefix - start + cost > budget:
            yield ([], system + new, system_cost + prefix) if first else (system + repeated, new, system_cost + prefix - start)
            first = False
            room = min(history, budget - system_cost - cost)
            chosen = [(p, turn) for p, turn in before if prefix - p <= room]
            repeated, new = [turn for _, turn in chosen], []
            start = chosen[0][0] if chosen else prefix
        new.append((role, text))
        before.append((prefix, (role, text)))
        prefix += cost
        while before and prefix - before[0][0] > history:
            before.popleft()
    if first and (new or system):
        yield [], system + new, system_cost + prefix
    elif new:
        yield system + repeated, new, system_cost + prefix - start


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and end of a rendered turn."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def render(repeated: list, new: list) -> tuple[str, list[int], list[int]]:
    """Text of a window and the spans of its loss mask, in code points."""
    parts, starts, ends, at = [], [], [], 0
    for i, (role, text) in enumerate([*repeated, *new]):
        head, body, end = turn_parts(role, text)
        if i >= len(repeated) and role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts.append(head + body + end)
        at += len(parts[-1])
    return "".join(parts), starts, ends


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _grouped(batches, names: list[str]):
    """Runs of rows of one conversation, as ``(id, iterator)``, over batches."""
    from itertools import groupby
    from operator import itemgetter

    rows = (row for b in batches for row in zip(*[b.column(n).to_pylist() for n in names], strict=True))
    return groupby(rows, key=itemgetter(0))


def _measured(vocabulary: str):
    """Adds the tokens of each rendered turn."""

    def measure(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, _TURNS):
                part = batch.slice(at, _TURNS)
                said = zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)
                costs = encode.counts(["".join(turn_parts(role, text)) for role, text in said])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs, pa.int64())], _MEASURED)

    return measure


def _formatter(budget: int, history: int):
    def write(batches):
        out: list[tuple] = []
        size = 0
        for conv, rows in _grouped(batches, ["conv_id", "role", "text", "cost"]):
            last = [0]  # tokens of the turn that was drawn last

            def turns(rows=rows, last=last):
                for _, role, text, last[0] in rows:
                    yield role, text

            count = lambda role, text, last=last: last[0]
            for number, (repeated, new, tokens) in enumerate(windows_of(turns(), count, budget, history, marks=0)):
                text, starts, ends = render(repeated, new)
                out.append((conv, number, text, len(new), len(repeated), tokens, starts, ends, tokens > budget))
                size += len(text)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return write


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.bool_()]
    names = [x.split()[0] for x in _WINDOWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def format_windows(
    conversations: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """The windows of every conversation (``conv_id, turn, role, text``)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    kinds = ["conv_id long", f"turn {rows.schema['turn'].dataType.simpleString()}", "role string", "text string", "cost long"]
    rows = rows.mapInArrow(_measured(vocabulary), ", ".join(kinds))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text", "cost").mapInArrow(_formatter(budget, history), _WINDOWS)


def _digests(batches):
    names = ["conv_id", "text", "n_repeated", "loss_starts", "loss_ends"]
    out = []
    for conv, rows in _grouped(batches, names):
        turns, loss, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, text, repeated, starts, ends in rows:
            for role, said in parse(text)[repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for a, b in zip(starts, ends, strict=True):
                learnt = unescape(text[a:b])
                loss.update(learnt.encode())
                chars += len(learnt)
            formatted += len(text)
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], columns)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations, parsed from the text of their windows."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "text", "n_repeated", "loss_starts", "loss_ends").mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def report(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the windows to the shared folder and reads them back."""
    spark = conversations.sparkSession
    path = scratch_path(spark, "chat-windows")
    format_windows(conversations, vocabulary).write.parquet(path)
    return read_back(spark.read.schema(_WINDOWS).parquet(path))
