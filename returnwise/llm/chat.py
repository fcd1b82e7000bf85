"""Chat formatting in budgeted windows.

A conversation is a sequence, so its turns stream in order through one task, a turn at a time; what
is held is a window and the system turn, never the conversation. Prefix sums of the turns' tokens
choose where a window ends. A window repeats the system turn and the last turns before it as
history; repeated turns are masked, so every assistant text is a target exactly once.
"""

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.llm.common import ship
from returnwise.llm.packing import Ids

#: Tokens a window may have, and how many of them repeated history may take.
BUDGET = 2048
HISTORY = 512
#: Tokens that a turn's marks add.
MARKS = 8

START, END = "<|im_start|>", "<|im_end|>"
TARGET, SYSTEM = "assistant", "system"


def escape(text: str) -> str:
    """Text without ``<|``; :func:`unescape` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return text.replace("<\\|", "<|").replace("\\\\", "\\") if "\\" not in text else _unescape(text)


def _unescape(text: str) -> str:
    out, at = [], 0
    while (next_ := text.find("\\", at)) >= 0:
        out.append(text[at:next_])
        out.append(text[next_ + 1 : next_ + 2])
        at = next_ + 2
    out.append(text[at:])
    return "".join(out)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\\x00")


def _role_back(role: str) -> str:
    return "\n".join(unescape(part) for part in _split_role(role))


def _split_role(role: str) -> list[str]:
    parts, at, i = [], 0, 0
    while i < len(role):
        if role[i] == "\\":
            if role[i + 1 : i + 2] == "\x00":
                parts.append(role[at:i])
                at = i + 2
            i += 2
        else:
            i += 1
    return [*parts, role[at:]]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and where each escaped text starts and ends."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, body = part.split("\n", 1)
        turns.append((_role_back(role), unescape(body[: body.rindex(END)])))
    return turns


_DDL = (
    "conv_id bigint, window int, formatted string, repeated int, "
    "loss array<struct<start:int,end:int>>, tokens bigint, over_budget boolean"
)
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("repeated", pa.int32()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("tokens", pa.int64()), ("over_budget", pa.bool_()),
])


def windows(turns: Iterator[tuple[str, str, int]], budget: int, history: int):
    """``(turns, repeated, tokens)`` of each window of one conversation's ``(role, text, tokens)``."""
    system: tuple | None = None
    before: deque = deque()  # the turns before the window, within the history's budget
    held = 0
    window: list = []
    used = fixed = 0
    repeated = 0
    first = True
    for turn in turns:
        if window and used + turn[2] > budget and len(window) > repeated:
            yield window, repeated, used
            window = []
        if not window:
            head = [system] if system and not first else []
            fixed = sum(t[2] for t in head)
            past = [t for t in before if not (head and t is system)]
            # The latest turns whose tokens, with the new turn's, leave the window in its budget.
            room = min(history, budget - fixed - turn[2])
            kept: list = []
            for t in reversed(past):
                room -= t[2]
                if room < 0:
                    break
                kept.insert(0, t)
            window, repeated = [*head, *kept], len(head) + len(kept)
            used = sum(t[2] for t in window)
        if first and turn[0] == SYSTEM:
            system = turn
        first = False
        window.append(turn)
        used += turn[2]
        before.append(turn)
        held += turn[2]
        while before and held > history:
            held -= before.popleft()[2]
    if window:
        yield window, repeated, used


def format_conversations(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, files: tuple[str, str] | None = None
) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``, in order within each task's conversations.

    Returns conv_id, window, formatted, repeated (turns at the window's start that are no targets),
    loss (spans of target texts in ``formatted``), tokens and over_budget. A NULL role or text is
    empty. Turns are ordered by turn, NULL first, ties by role and text; repeated rows are turns of
    their own. Rows without a conv_id form one conversation. A turn longer than the budget stands
    whole in a window of its own, with the system turn, and is marked over_budget.
    """
    ship(turns.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        ids = Ids(files)

        def rows():
            for batch in batches:
                for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield conv, role, text, len(ids(text)) // 4 + MARKS

        made: list[tuple] = []
        size = 0
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            for k, (window, repeated, tokens) in enumerate(windows(((r[1], r[2], r[3]) for r in own), budget, history)):
                text, spans = render([(t[0], t[1]) for t in window])
                loss = [
                    {"start": a, "end": b}
                    for (role, *_), (a, b) in list(zip(window, spans))[repeated:] if role == TARGET
                ]
                made.append((conv, k, text, repeated, loss, tokens, tokens > budget))
                size += len(text)
                if size > 4_000_000:
                    yield _batch(made)
                    made, size = [], 0
        if made:
            yield _batch(made)

    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "turn",
    )
    return (
        clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text").mapInArrow(work, _DDL)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], _SCHEMA.field(i).type) for i in range(len(_SCHEMA))], schema=_SCHEMA
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows say, read back from them: turns, targets and sizes of each conversation.

    ``formatted`` must be as :func:`format_conversations` gives it, a conversation's windows in
    order in one task.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        from itertools import groupby

        out: list[tuple] = []
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = size = count = 0
            for _, text, repeated, spans in own:
                for role, body in parse(text)[repeated:]:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    chars += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
                size += len(text)
                count += 1
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=list(names))

    ddl = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_windows bigint"
    )
    return formatted.select("conv_id", "formatted", "repeated", "loss").mapInArrow(work, ddl)


def query(conversations: DataFrame) -> DataFrame:
    """The digest of all conversations and of one whose texts are made of control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return digest(format_conversations(turns.union(extra)))
