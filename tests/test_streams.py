from pyspark.sql import functions as F

from pagewright.operators import lifecycle
from pagewright.streaming import streams


def test_states_of_a_stream_are_the_batch_ones(spark, tmp_path):
    rows = [("a", 0, "start"), ("a", 1, "extract"), ("b", 0, "pause"), ("b", 1, "start"), ("a", 2, "finish")]
    df = spark.createDataFrame(rows, "task_id string, seq int, command string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.task_states(streams.table_stream(spark, str(tmp_path / "in"), df.schema))
    seen = []
    streams.run_available(stream, lambda batch, n: seen.extend(map(tuple, batch.collect())), str(tmp_path / "state"), "update")
    assert sorted(seen) == sorted(map(tuple, lifecycle.replay_tasks(df).select("task_id", "state", "refused", "last_error").collect()))


def test_repetitions_are_dropped_and_a_failing_sink_is_not_everyones(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.deduplicated(streams.table_stream(spark, str(tmp_path / "in"), df.schema), ["k"], "t")
    seen, errors = [], []

    def broken(batch, n):
        raise ValueError("sink")

    streams.run_available(stream, streams.fan_out([broken, lambda b, n: seen.extend(r["k"] for r in b.collect())], errors.append), str(tmp_path / "state"))
    assert sorted(seen) == [0, 1, 2] and errors
