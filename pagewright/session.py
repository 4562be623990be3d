"""Session factory and lineage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "pagewright", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword entries use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not (context.master == "local" or context.master.startswith("local[")):  # executors on other machines, or processes of their own
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "pagewright-checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage like ``cut``, but columns stay
    compressed and can be pruned.  The table is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        try:
            java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)
        except Exception:
            pass  # the session is gone; the folder is the cluster's to clean

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so that it survives lost executors.

    The folder is the one named by ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
