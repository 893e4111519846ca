"""Tables of a job's own in the folder that the session names for checkpoints: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What Python workers are handed at a time while a table is settled: rows may be whole texts, and each batch is held several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: The tables that settled() has written in a thread and nobody has discarded, oldest first: what one thread discards is never another's.
_of_thread = threading.local()


def _written() -> list[str]:
    if not hasattr(_of_thread, "tables"):
        _of_thread.tables = []
    return _of_thread.tables


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session of one machine gets a folder of its own where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The session hands Python workers small batches in the jobs that are planned meanwhile."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def settled(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rows of df as a table in the session's checkpoint folder, with the lineage cut, in folders by some columns if wanted. discard() removes it again."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A mark for discard(), in this thread."""
    return len(_written())


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables that this thread settled since a mark; what was made from them must have been written."""
    tables = _written()
    for path in tables[since:]:
        remove(spark, path)
    del tables[since:]


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving, also by an error, what was settled meanwhile; results must have been written or collected by then."""
    since = mark()
    try:
        yield
    finally:
        discard(spark, since)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer parts than there are cores, such as one small file, is dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
