"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tickloom/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within are deleted at the end, but for those to ``keep``, which live as long as what is around."""
    own: list[str] = []
    made = _made.set((*_made.get(), own))
    try:
        yield
    finally:
        _made.reset(made)
        for path in own:
            delete(spark, path)


def materialise(df: DataFrame, tag: str, partition_by: str | None = None, *, keep: bool = False, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage: a lost executor costs no earlier
    stage. The shuffle files of the write are removed when it ends. Python gets texts a thousand at a time, which keeps batches of texts small."""
    spark = df.sparkSession
    path, before = shared_path(spark, tag), {CLEANUP: spark.conf.get(CLEANUP, "false"), RECORDS: spark.conf.get(RECORDS)}
    for made in _made.get()[-1 - keep : len(_made.get()) - keep]:
        made.append(path)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(RECORDS, min(1000, int(before[RECORDS])) if int(before[RECORDS]) > 0 else 1000)
    try:
        writer = df.write.options(**options)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables of ``materialise``, or a part (``column=value``) of them, that nothing reads any more, since what came of them is written."""
    for df in tables:
        delete(df.sparkSession, f"{df._shared_path}/{part}" if part else df._shared_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with about ``most`` bytes; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())
