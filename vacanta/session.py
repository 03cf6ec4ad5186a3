"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Keyed state with timers and expiry needs this store.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # folder names are text: a month "01" must not come back as the number 1
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    STATE_STORE[0]: STATE_STORE[1],
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume and return the session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What runs here, or in a stream started here, drops its shuffle files as soon as each execution ends.

    Else they stay until the driver collects its garbage, so the files of many steps lie on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is made only in local mode, where there is one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="vacanta-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for tables written by one run, inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Unlike a checkpointed frame the table carries nothing of the plan it came from, so loops
    may go on from it any number of times. ``options`` go to the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
