"""Task states and the retry budget: ordered folds inside one key.

A fold over the events of a key is written once as a plain function and used in batch (over stretches that compose, or by
``aggregate`` over the key's sorted array) and in streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which command leads from which state where, and the code of a refused one.
TRANSITIONS = {
    ("pause", "pending"): "paused",
    ("resume", "paused"): "pending",
    ("start", "pending"): "running_ocr",
    ("extract", "running_ocr"): "running_extract",
    ("finish", "running_extract"): "done",
    ("fail", "running_ocr"): "failed",
    ("fail", "running_extract"): "failed",
    ("retry", "failed"): "paused",
}
REFUSED = {"pause": "E_PAUSE_001", "resume": "E_RESUME_001", "retry": "E_RETRY_001", "start": "E_QUEUE_001", "extract": "E_QUEUE_001", "finish": "E_QUEUE_001", "fail": "E_QUEUE_001", "clear": "E_CLEAR_001"}
RETRY_BUDGET, RETRY_UNIMPROVED = 6, 2


def step(state: str, command: str) -> tuple[str, str | None]:
    """(next state, error code of a refused command)."""
    if command == "clear":
        return (state, REFUSED["clear"]) if state.startswith("running") else ("removed", None)
    new = TRANSITIONS.get((command, state))
    return (new, None) if new else (state, REFUSED.get(command, "E_UI_001"))


def replay(commands: Iterable[str], state: str = "pending") -> tuple[str, int, str | None]:
    """(last state, refused commands, code of the last refused one)."""
    refused, code = 0, None
    for c in commands:
        state, error = step(state, c)
        if error:
            refused, code = refused + 1, error
    return state, refused, code


STATES = tuple(dict.fromkeys(["pending", *(s for _, s in TRANSITIONS), *TRANSITIONS.values(), "removed"]))
_RUN = T.StructType([T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("refused", T.ArrayType(T.LongType())), T.StructField("errors", T.ArrayType(T.StringType()))])


class Runs:
    """Stretches of commands as functions of the state before them: where each state leads, how many commands it refuses, the code of the last one.

    Functions of stretches are composed, so a long history can be cut anywhere and its stretches folded side by side."""

    def __init__(self):
        self.known: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], tuple[int, ...], str | None]] = {}

    def _next(self, at: tuple[int, ...], command: str) -> tuple[tuple[int, ...], tuple[int, ...], str | None]:
        """(states after one more command, the starting states for which it is refused, the code of the refusal)."""
        steps = [step(STATES[s], command) for s in at]
        return tuple(STATES.index(s) for s, _ in steps), tuple(i for i, (_, e) in enumerate(steps) if e), next((e for _, e in steps if e), None)

    def fold(self, commands: Iterable[str], run: tuple | None = None) -> tuple[tuple[int, ...], list[int], list[str | None]]:
        at, refused, errors = run or (tuple(range(len(STATES))), [0] * len(STATES), [None] * len(STATES))
        for c in commands:
            found = self.known.get((at, c))
            if found is None:
                found = self.known[at, c] = self._next(at, c)
            at, hit, code = found
            for i in hit:
                refused[i] += 1
                errors[i] = code
        return at, refused, errors


def replay_tasks(commands: DataFrame, key: str = "task_id", order: str = "seq", command: str = "command") -> DataFrame:
    """``key``, ``state``, ``refused`` and ``last_error`` after all commands in order; commands without a key belong to no task.

    Commands are ranged by key and order, so the history of a key that holds a large part of all rows lies on as many partitions as it needs.  Each partition
    folds its stretch of a key, batch by batch, to one function of the state before it; the few functions of a key are then applied in order, in the JVM."""
    schema = T.StructType([T.StructField("k", commands.schema[key].dataType), T.StructField("first", commands.schema[order].dataType), *_RUN.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, open_key, first, now = Runs(), None, None, None
        for batch in batches:
            done = []
            starts = np.flatnonzero((batch["k"] != batch["k"].shift()).to_numpy())
            words = batch["c"].tolist()
            for a, b in zip(starts, [*starts[1:], len(words)]):
                k = batch["k"].iloc[a]
                if now is not None and k != open_key:
                    done.append((open_key, first, *now))
                    now = None
                if now is None:
                    open_key, first = k, batch["o"].iloc[a]
                now = runs.fold(words[a:b], now)
            yield pd.DataFrame(done, columns=schema.names)
        if now is not None:
            yield pd.DataFrame([(open_key, first, *now)], columns=schema.names)

    ranged = commands.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(command).alias("c")).repartitionByRange("k", "o", "c").sortWithinPartitions("k", "o", "c")
    packed = ranged.mapInPandas(run, schema).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("first", "ends", "refused", "errors"))).alias("runs"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(None).cast("string").alias("error"))
    at = lambda x, field, s: F.get(x[field], s["state"])
    done = packed.select("k", F.aggregate("runs", start, lambda s, x: F.struct(at(x, "ends", s).alias("state"), (s["refused"] + at(x, "refused", s)).alias("refused"), F.coalesce(at(x, "errors", s), s["error"]).alias("error"))).alias("r"))
    return done.select(F.col("k").alias(key), F.get(F.array(*map(F.lit, STATES)), F.col("r.state")).alias("state"), F.col("r.refused").cast("int").alias("refused"), F.col("r.error").alias("last_error"))


def retry_budget(pages: DataFrame, key: str = "task_id", order: str = "page_index", budget: int = RETRY_BUDGET, unimproved: int = RETRY_UNIMPROVED) -> DataFrame:
    """``key``, ``budget_left``, ``streak`` and ``disabled`` after a document's pages in order.

    Each retry that is triggered costs one; one that is applied ends the streak of retries without gain; at no budget left or a
    streak of ``unimproved`` there are no more.  One ``aggregate`` with struct state, no Python."""
    packed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("retry_triggered", F.lit(False)).alias("t"), F.coalesce("retry_applied", F.lit(False)).alias("a")))).alias("ps"))
    start = F.struct(F.lit(budget).alias("left"), F.lit(0).alias("streak"), F.lit(False).alias("off"))

    def fold(s: Column, p: Column) -> Column:
        counts = p["t"] & ~s["off"]
        left = F.when(counts, s["left"] - 1).otherwise(s["left"])
        streak = F.when(counts, F.when(p["a"], 0).otherwise(s["streak"] + 1)).otherwise(s["streak"])
        return F.struct(left.alias("left"), streak.alias("streak"), (s["off"] | (left <= 0) | (streak >= unimproved)).alias("off"))

    done = packed.select(key, F.aggregate("ps", start, fold).alias("r"))
    return done.select(key, F.col("r.left").alias("budget_left"), "r.streak", F.col("r.off").alias("disabled"))


@dataclass(frozen=True)
class Waiting:
    task_id: str
    kind: str
    status: str


def decide_admission(tasks: list[Waiting], seen: set[str], ocr_busy: bool, text_running: bool, pipeline_busy: bool) -> tuple[str, str | None]:
    """(admit, task), (wait, None) or (done, None): the first pending task not seen yet; texts only into an idle pipeline, images and
    PDFs only while recognition is idle and no text runs."""
    for t in tasks:
        if t.status != "pending" or t.task_id in seen:
            continue
        free = not pipeline_busy if t.kind == "text" else not ocr_busy and not text_running
        return ("admit", t.task_id) if free else ("wait", None)
    return "done", None


def fold_groups(df: DataFrame, key: str, order: str, command: str, schema: str = "task_id string, state string, refused int, last_error string") -> DataFrame:
    """The same replay with ``applyInPandas``: the model that the JVM fold is tested against."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, refused, code = replay(rows.sort_values(order)[command])
        return pd.DataFrame([(rows[key].iloc[0], state, refused, code)], columns=["task_id", "state", "refused", "last_error"])

    return df.groupBy(key).applyInPandas(run, schema)
