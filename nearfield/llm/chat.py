"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A line shows a marker (``User:``, ``### Response`` ...), its length, whether it asks and whether it
begins a passage. Hidden is the role that speaks and whether the line is the first of a turn. The
model is counted from labelled conversations. The Viterbi path of a conversation of any length is
found in blocks: each block yields its best score between every two states (max-plus products
compose), blocks are composed in groups up to one product per conversation, and the best states at
the ends are handed down again, group by group, until every block traces its own lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
#: States: each role's first line of a turn and its later lines; the last state is before any line.
STATES = [(role, first) for role in ROLES for first in (True, False)]
START = len(STATES)
#: Stands for a null conversation id.
NO_CONVERSATION = -(1 << 63)
#: Passages per block, and blocks composed at a time.
BLOCK, FAN_IN = 32, 64
#: Order of the lines of a conversation; ``tie`` is a hash of the line.
ORDER = ("seq", "line", "tie")
#: Added to the count of every symbol of a state. Transitions get a half: a role's marker says more than its place.
UNSEEN = 0.05
#: Lines per batch of results.
BATCH = 10_000

# Speaker markers in common use (fixed values): the words before a colon or after ###.
_MARKERS = {
    "system": ("system", "context", "rules", "sys"),
    "user": ("user", "human", "question", "q", "instruction", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "agent", "gpt"),
}
_MARKER = {role: rf"(?i)^\s*(?:###\s*(?:{'|'.join(w)})\s*:?|\*{{0,2}}(?:{'|'.join(w)})\*{{0,2}}\s*:)\s*" for role, w in _MARKERS.items()}
SYMBOLS = (len(ROLES) + 1) * 3 * 2 * 2


def marker(line: Column) -> Column:
    """1 + the role whose marker begins the line, 0 for none."""
    out = F.lit(0)
    for n, role in enumerate(ROLES):
        out = F.when(line.rlike(_MARKER[role]), n + 1).otherwise(out)
    return out


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, "|".join(f"(?:{p.replace('(?i)', '')})" for p in _MARKER.values()).join(("(?i)", "")), "")


def lines(passages: DataFrame) -> DataFrame:
    """``conv_id, seq, line, text, tie, symbol`` of passages ``conv_id, seq, text``; null text is empty."""
    rows = passages.select("conv_id", "seq", *([c for c in ("role",) if c in passages.columns]), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    n = F.length("text")
    size = F.when(n < 60, 0).when(n < 300, 1).otherwise(2)
    asks = F.col("text").rlike(r"\?\s*$").cast("int")
    begins = (F.col("line") == 0).cast("int")
    return rows.withColumn("tie", F.xxhash64("text")).withColumn("symbol", ((marker(F.col("text")) * 3 + size) * 2 + asks) * 2 + begins)


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log transition ``(START + 1, START)`` and emission ``(START, SYMBOLS)`` matrices, smoothed.

    ``labelled`` holds passages ``conv_id, seq, role, text``, one turn each; other roles are left out.
    """
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    rows = lines(labelled.where(F.col("role").isin(*ROLES))).withColumn("state", (role * 2 + (F.col("line") > 0).cast("int")).cast("int"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "line")
    steps = rows.select(F.coalesce(F.lag("state").over(order), F.lit(START)).alias("before"), "state", "symbol")
    seen = steps.groupBy("before", "state", "symbol").count().toPandas()  # at most START^2 x SYMBOLS rows
    move, show = np.full((START + 1, START), 0.5), np.full((START, SYMBOLS), UNSEEN)
    np.add.at(move, (seen["before"], seen["state"]), seen["count"])
    np.add.at(show, (seen["state"], seen["symbol"]), seen["count"])
    return np.log(move / move.sum(1, keepdims=True)), np.log(show / show.sum(1, keepdims=True))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two ``(START + 1, START)`` score matrices: first ``a``, then ``b``."""
    return (a[:, :, None] + b[None, :START, :]).max(1)


def viterbi(symbols: np.ndarray, move: np.ndarray, show: np.ndarray, entry: int, leave: int | None = None) -> list[int]:
    """Best states after ``entry`` (and up to ``leave``); ties go to the lower state."""
    score, back = move[entry] + show[:, symbols[0]], []
    for s in symbols[1:]:
        step = score[:, None] + move[:START]
        back.append(step.argmax(0))
        score = step.max(0) + show[:, s]
    path = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Every block of a conversation in one partition, its lines in order."""
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *ORDER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a partition, one after the other."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        conv, block = (batch.column(c).to_numpy() for c in ("conv_id", "block"))
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if held and (conv[a], block[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = (conv[a], block[a])
    if held:
        yield pa.Table.from_batches(held)


def _block_scores(move: np.ndarray, show: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            total = None
            for s in rows["symbol"].to_numpy():
                step = move + show[:, s]
                total = step if total is None else compose(total, step)
            yield pa.RecordBatch.from_pydict({
                "conv_id": rows["conv_id"][:1].to_pylist(), "block": rows["block"][:1].to_pylist(), "scores": [total.ravel()]})

    return run


def _compose_group(rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for s in rows.sort_values("block")["scores"]:
        step = np.array(s).reshape(START + 1, START)
        total = step if total is None else compose(total, step)
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "block": rows["up"].iloc[:1], "scores": [total.ravel().tolist()]})


def _hand_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit states of a group's blocks, given those of the group."""
    rows = rows.sort_values("block")
    steps = [np.array(s).reshape(START + 1, START) for s in rows["scores"]]
    entry, leave = int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0])
    score, back = steps[0][entry], []
    for step in steps[1:]:
        both = score[:, None] + step[:START]
        back.append(both.argmax(0))
        score = both.max(0)
    path = [leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = path[::-1]
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "entry": [entry, *path[:-1]], "leave": path})


def _trace(move: np.ndarray, show: np.ndarray):
    """Best states of every block. A block of a longer conversation begins with a row of ``line`` -1
    that holds its entry and exit states in ``symbol``. ``begun`` counts the turns the block has begun."""

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for rows in _runs(batches):
            entry, leave = START, None
            symbols = rows["symbol"].to_numpy()
            if rows["line"][0].as_py() < 0:
                entry, leave = divmod(int(symbols[0]), START)
                rows, symbols = rows[1:], symbols[1:]
            state = np.array(viterbi(symbols, move, show, entry, leave))
            before = np.concatenate([[entry], state[:-1]])
            begins = (state % 2 == 0) | (state // 2 != before // 2)
            out = rows.drop_columns(["symbol"]).append_column("state", pa.array(state, pa.int32()))
            yield out.append_column("begins", pa.array(begins)).append_column("begun", pa.array(np.cumsum(begins), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for out in traced(batches):
            held.append(out)
            size += len(out)
            if size >= BATCH:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def decode(passages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every line with its state on the best path of its conversation.

    ``conv_id, block, seq, line, tie, text, state``, whether the line ``begins`` a turn, and how many
    turns its block has ``begun`` up to it.
    """
    move, show = model
    low = F.coalesce(F.col("seq"), F.lit(0))
    passages = passages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv_id"), low.cast("long").alias("seq"), "text")
    block = F.floor(F.col("seq") / BLOCK).alias("block")
    rows = lines(passages).select("conv_id", block, *ORDER, "text", "symbol")
    # Conversations of one block are traced at once; the others need the scores of their blocks first.
    spans = passages.groupBy("conv_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    ends_of = lambda size: [F.floor(F.col(c) / size).alias(c) for c in ("first", "last")]
    long = written(spans.select("conv_id", *ends_of(BLOCK)).where("first < last"), "long_conversations")
    span = lambda n: long.select(*ends_of(FAN_IN ** n)).agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    scores = "conv_id long, block long, scores array<double>"
    narrow = rows.drop("text").join(long.select("conv_id"), "conv_id", "left_semi")
    levels = [written(_in_blocks(narrow).mapInArrow(_block_scores(move, show), scores), "scores")]
    while span(len(levels) - 1):
        grouped = levels[-1].withColumn("up", F.floor(F.col("block") / FAN_IN))
        levels.append(written(grouped.groupBy("conv_id", "up").applyInPandas(_compose_group, scores), "scores"))
    # From the state before any line, the exit with the best score; ties go to the lower state.
    begin = F.slice("scores", START * START + 1, START)
    ends = levels[-1].select("conv_id", F.col("block").alias("up"), F.lit(START).alias("entry"),
                             (F.array_position(begin, F.array_max(begin)) - 1).cast("int").alias("leave"))
    for level in reversed(levels[:-1]):
        held = level.withColumn("up", F.floor(F.col("block") / FAN_IN)).join(ends, ["conv_id", "up"])
        ends = held.groupBy("conv_id", "up").applyInPandas(_hand_down, "conv_id long, block long, entry int, leave int").withColumnRenamed("block", "up")
    marks = ends.select(
        "conv_id", F.col("up").alias("block"), (F.col("up") * BLOCK).alias("seq"), F.lit(-1).alias("line"), F.lit(0).cast("long").alias("tie"),
        F.lit("").alias("text"), (F.col("entry") * START + F.col("leave")).alias("symbol"))
    return _in_blocks(rows.unionByName(marks)).mapInArrow(
        _trace(move, show),
        "conv_id long, block long, seq long, line int, tie long, text string, state int, begins boolean, begun long")


def turns(decoded: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n_lines, rendered``: lines joined to turns and rendered canonically."""
    decoded = written(decoded, "decoded")
    # One row per block, so a long conversation sends a small part of its rows to one running sum.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = decoded.groupBy("conv_id", "block").agg(F.max("begun").alias("n"))
    begun = begun.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")).where("earlier > 0")
    rows = decoded.join(begun, ["conv_id", "block"], "left").withColumn("turn", F.coalesce("earlier", F.lit(0)) + F.col("begun") - 1)
    role = F.floor(F.col("state") / 2)
    text = F.when(F.col("begins"), unmarked(F.col("text"))).otherwise(F.col("text"))
    line = F.struct(*ORDER, text.alias("text"))
    out = rows.groupBy("conv_id", "turn").agg(F.min(role).alias("role"), F.array_sort(F.collect_list(line)).alias("lines"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("role") + 1).cast("int"))
    body = F.regexp_replace(F.array_join(F.col("lines.text"), "\n"), r"^\n", "")  # a marker on a line of its own
    return out.select(
        "conv_id", "turn", role.alias("role"), body.alias("text"), F.size("lines").alias("n_lines"),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body, F.lit("<|im_end|>\n")).alias("rendered"))


def formatted(transcripts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Turns of raw ``transcripts`` (``conv_id, seq, text``), with roles learned from ``labelled``.

    Null texts are empty lines and null sequence numbers count as 0. Passages without a conversation id
    form one conversation, whose id stays null; so would the least of all longs.
    Repeated passages stay; lines of equal number follow in the order of a hash. Without labelled rows all roles are equally likely. Empty
    tables give no rows; further columns are ignored.
    """
    out = turns(decode(transcripts, train(labelled)))
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit(NO_CONVERSATION)))
