"""The batch operators over streams.

Files arrive through the file source (``maxFilesPerTrigger`` is the backpressure), results leave through ``foreachBatch`` with the
same functions as in batch; task states are a stateful operator keyed by task, whose state goes when the task is removed (a timeout by processing time would keep a run over
what is there from ending)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import step


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """First arrivals only; state is kept as long as a repetition can come, later ones are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_badges(stream: DataFrame, time: str = "ingested_at", width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Counts of states in windows of event time."""
    s = F.col("status")
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("total"), F.count_if(s == "done").alias("success"), F.count_if(s == "failed").alias("failed")).select("window.start", "window.end", "total", "success", "failed")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, refused = state.get if state.exists else ("pending", 0)
    code = None
    rows = pd.concat(list(batches)).sort_values("seq")
    for command in rows["command"]:
        name, error = step(name, command)
        refused += error is not None
        code = error or code
    if name == "removed":
        state.remove()
    else:
        state.update((name, int(refused)))
    yield pd.DataFrame([(key[0], name, int(refused), code)], columns=["task_id", "state", "refused", "last_error"])


def task_states(commands: DataFrame) -> DataFrame:
    """The state of each task after the commands that have come (task_id, seq, command), one row a task that has news."""
    return commands.groupBy("task_id").applyInPandasWithState(_advance, "task_id string, state string, refused int, last_error string", "state string, refused int", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", limit_s: float | None = None) -> None:
    """Work off what is there, however long it takes (or at most ``limit_s``): each micro batch goes through ``each``; a failure in it stops the query with its offsets kept."""
    running = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        ended = running.awaitTermination(limit_s)
        if limit_s is not None and not ended:
            raise TimeoutError(f"the stream did not end within {limit_s} s")
    finally:
        running.stop()


def fan_out(sinks: list[Callable[[DataFrame, int], None]], failed: Callable[[Exception], None] = lambda e: None) -> Callable[[DataFrame, int], None]:
    """One batch to many sinks; a sink that fails does not keep the others from it."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:
                    failed(e)
        finally:
            batch.unpersist()

    return each
