"""Chat formatting in budgeted windows.

Turns get token counts, and prefix sums of these give each turn its place in the conversation. Cells of a fixed number of
tokens cut a conversation of any length into bounded groups, and within a cell windows are spans of whole turns chosen on the
prefix sums. A window repeats the system turn and a limited history before its new turns, and only new assistant turns are
targets. Prefix sums are made of block sums, so no task ever holds a whole conversation.

Template: a window is ``<s>`` and its turns; a turn is its role's opening mark, the text, its closing mark. Marks inside texts
are broken by an escape character, which is escaped itself, so that the text comes back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.batches import whole_groups
from palisade.llm.registry import query
from palisade.storage import materialize

OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[ANS]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE, ROLE_END, NO_ROLE = "[TURN]", "[/TURN]", "[:]", "[NONE]"
BEGIN = "<s>"
MARKS = (BEGIN, *OPEN.values(), *CLOSE.values(), OTHER_OPEN, OTHER_CLOSE, ROLE_END, NO_ROLE)
ESCAPE = "␛"

BUDGET = 2048  # tokens of a window
HISTORY = 512  # tokens of repeated turns, at most
CELL = 8 * BUDGET  # tokens of new turns that are windowed together
BLOCK = 256  # turn numbers whose tokens are summed together
TURN_COST = 4  # tokens of a turn's marks, about

_ANY_MARK = re.compile("|".join(re.escape(m) for m in MARKS))
_CLOSING = re.compile("|".join(re.escape(m) for m in (*CLOSE.values(), OTHER_CLOSE)))
_ROLE_OF = {mark: role for role, mark in OPEN.items()}
_OPENING = re.compile("|".join(re.escape(m) for m in (*OPEN.values(), OTHER_OPEN)))

WINDOW = "conv_id long, first_token long, formatted string, tokens long, repeated int, turns int, spans array<struct<start: int, end: int>>, over_budget boolean"


def escape(text: str) -> str:
    """The text without any template mark; ``unescape`` gives it back."""
    return _ANY_MARK.sub(lambda m: f"{m[0][0]}{ESCAPE}1{m[0][1:]}", text.replace(ESCAPE, f"{ESCAPE}0"))


def unescape(text: str) -> str:
    return text.replace(f"{ESCAPE}1", "").replace(f"{ESCAPE}0", ESCAPE)


def write_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text with the closing mark left out starts and ends."""
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        head, tail = OTHER_OPEN + (NO_ROLE if role is None else escape(role)) + ROLE_END, OTHER_CLOSE
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and texts of a window's turns. Raises ``ValueError`` on what the template can't have written."""
    if not formatted.startswith(BEGIN):
        raise ValueError("a window starts with its mark")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        opening = _OPENING.match(formatted, at)
        closing = _CLOSING.search(formatted, at)
        if not opening or not closing:
            raise ValueError(f"no turn at character {at}")
        body = formatted[opening.end() : closing.start()]
        if opening[0] == OTHER_OPEN:
            role, _, body = body.partition(ROLE_END)
            role = None if role == NO_ROLE else unescape(role)
        else:
            role = _ROLE_OF[opening[0]]
        turns.append((role, unescape(body)))
        at = closing.end()
    return turns


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text, about: a token for four bytes."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def _spans(starts: np.ndarray, ends: np.ndarray, budget: int, lead: int, history: int) -> Iterator[tuple[int, int, int]]:
    """``(back, first, stop)`` for each window over turns ``first`` to ``stop``, with history from turn ``back``.

    ``starts`` and ``ends`` are prefix sums before and after each turn; turns before ``lead`` can only be history. ``history``
    and the system turn are taken off the budget first; a turn that is too long gets a window of its own, without history.
    """
    first = lead
    while first < len(starts):
        back = int(np.searchsorted(starts[:first], starts[first] - min(history, max(0, budget - (ends[first] - starts[first])))))
        stop = int(np.searchsorted(ends, starts[back] + budget, side="right"))
        stop = max(first + 1, stop)
        yield back, first, stop
        first = stop


def format_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens: Column | None = None,
    budget: int = BUDGET,
    history: int = HISTORY,
    cell: int = CELL,
) -> DataFrame:
    """A row per window: ``formatted``, its order in the conversation (``first_token``), its ``tokens``, how many of its leading
    turns are ``repeated``, and ``spans`` (code points) of the targets: the texts of its new assistant turns.

    Every turn is new in exactly one window. Turns go by number, null first; turns with equal numbers go by role and text, and
    repeated rows all stay. Null text counts as empty, an unknown or null role gets marks that carry it, rows with a null
    conversation form one conversation. A first turn with the role system is repeated in every window. A turn
    above the budget gets a window of its own with ``over_budget`` set. ``tokens`` is a column of token counts of ``text``;
    without it four bytes count as a token. An empty table gives no rows; other columns are ignored.
    """
    base = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([] if tokens is None else [tokens.alias("own_tokens")]),
    )
    size = (estimated_tokens(F.col("text")) if tokens is None else F.col("own_tokens")) + TURN_COST
    order = ["turn", "role", "text"]
    # keys without nulls, so that the window and the join below share one partitioning of the texts
    keys = {"own": F.coalesce("conv", F.lit(0)), "none": F.col("conv").isNull(), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))}
    sized = base.withColumn("size", size.cast("long")).withColumns(keys).drop("own_tokens")

    sums = sized.groupBy(*keys).agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("own", "none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(sums, list(keys))
    placed = placed.withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.withColumn("cell", F.floor(F.col("start") / cell)).select("conv", "cell", "start", "end", "role", "text")

    # a turn goes to its own cell, and to the next ones where it may be history; the system turn goes to all later cells
    last = placed.groupBy("conv").agg(F.max("cell").alias("last")).withColumnRenamed("conv", "c")
    is_system = (F.col("start") == 0) & F.col("role").eqNullSafe("system")
    system = placed.where(is_system).join(last, F.col("conv").eqNullSafe(F.col("c"))).where("last > 0")
    system = system.select("conv", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("cell"), "start", "end", "role", "text", F.lit(0).alias("kind"))
    spread = F.explode(F.sequence(F.col("cell"), F.greatest("cell", F.floor((F.col("start") + history) / cell)))).alias("to")
    rows = placed.select("conv", "cell", "start", "end", "role", "text", spread).select(
        "conv", F.col("to").alias("cell"), "start", "end", "role", "text",
        F.when(F.col("to") == F.col("cell"), F.when(is_system, 0).otherwise(2)).otherwise(1).alias("kind"),
        (is_system & (F.col("to") > F.col("cell"))).alias("twice"),
    )
    rows = rows.where("NOT twice").drop("twice").union(system)
    keys = ["conv", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in WINDOW.replace("array<struct<start: int, end: int>>", "array").split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_()]
        for table in whole_groups(batches, keys, 2048):
            found: list[tuple] = []
            for group in _groups(table.to_pylist()):
                found += _windows(group, budget, history)
            columns = list(zip(*found)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "start", "end").mapInArrow(run, WINDOW)


def _groups(rows: list[dict]) -> Iterator[list[dict]]:
    at = 0
    while at < len(rows):
        stop = at + 1
        while stop < len(rows) and rows[stop]["conv"] == rows[at]["conv"] and rows[stop]["cell"] == rows[at]["cell"]:
            stop += 1
        yield rows[at:stop]
        at = stop


def _windows(group: list[dict], budget: int, history: int) -> Iterator[tuple]:
    """Windows over one cell of a conversation."""
    system = group[0] if group[0]["kind"] == 0 else None
    own_system = system is not None and system["cell"] == 0
    turns = [r for r in group if r is not system]
    lead = next((i for i, r in enumerate(turns) if r["kind"] == 2), len(turns))
    starts, ends = np.array([r["start"] for r in turns], np.int64), np.array([r["end"] for r in turns], np.int64)
    cost = system["end"] - system["start"] if system else 0
    spans = list(_spans(starts, ends, max(1, budget - cost), lead, history))
    if own_system and not spans:  # a conversation that is a system turn only
        spans = [(lead, lead, lead)]
    for number, (back, first, stop) in enumerate(spans):
        fresh_system = own_system and number == 0
        chosen = ([(system, not fresh_system)] if system else []) + [(r, back + i < first) for i, r in enumerate(turns[back:stop])]
        if fresh_system and back < first:
            raise AssertionError("the first window has no history")
        text, masks = BEGIN, []
        for row, repeated in chosen:
            written, low, high = write_turn(row["role"], row["text"])
            if row["role"] == "assistant" and not repeated:
                masks.append({"start": len(text) + low, "end": len(text) + high})
            text += written
        tokens = cost + (int(ends[stop - 1] - starts[back]) if stop > back else 0)
        place = 0 if fresh_system else int(starts[first])
        yield group[0]["conv"], place, text, tokens, sum(r for _, r in chosen), len(chosen), masks, tokens > budget


def read_conversations(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` per conversation, parsed from the windows.

    Windows of a conversation are streamed in order, with one running digest: memory holds a window, not a conversation.
    Null conversation ids are one conversation. Empty texts are turns of their own, equal turns come in the order they were
    written in, and no windows give no rows.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        count = loss_chars = chars = 0
        turns = loss = None
        done: list[tuple] = []

        def finished() -> tuple:
            return current[0], count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            for row in batch.to_pylist():
                if current != (row["conv_id"],):
                    if current:
                        done.append(finished())
                    current, count, loss_chars, chars = (row["conv_id"],), 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                formatted = row["formatted"]
                chars += len(formatted)
                for role, text in read_turns(formatted)[row["repeated"] :]:
                    count += 1
                    turns.update(f"{role or ''}\n{text}\n".encode())
                for span in row["spans"]:
                    text = unescape(formatted[span["start"] : span["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
            if len(done) >= 1000:
                yield _records(done, names)
                done = []
        if current:
            done.append(finished())
        if done:
            yield _records(done, names)

    chosen = windows.select("conv_id", "first_token", "formatted", "repeated", "spans")
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "first_token").mapInArrow(run, schema)


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@query("op10_budgeted_chat_windows")
def op10_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    windows = materialize(format_windows(given.union(extra)), "windows")
    return read_conversations(windows)
