"""Streaming ingestion: parse, judge lateness against the chunk table, store, count, and tend the chunks.

Lateness is by the wall clock and the chunk table, not by a watermark: a watermark would also drop points whose chunk is gone, which
are to open it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import parse_put
from ..operators.lifecycle import METRICS_DELAY, STALE_DELAY, Store, late_status
from ..sources.base import given

COUNTED = ("accepted", "delayed", "invalid")


def judged(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parsed lines with ``status``: accepted, delayed or invalid."""
    parsed = parse_put(lines)
    late = late_status(parsed, chunks)
    return late.withColumn("status", F.when(F.col("reject_reason").isNotNull(), "invalid").otherwise(F.col("status")))


def counters(judged_lines: DataFrame) -> DataFrame:
    return judged_lines.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Ingest:
    """Batches of lines into a store."""

    store: Store
    metrics_delay: int = METRICS_DELAY
    stale_delay: int = STALE_DELAY
    totals: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTED, 0))

    def batch(self, lines: DataFrame, batch_id: int, now: int | None = None, stream: str = "") -> None:
        """lines: (value, and seq within the batch if there is an order to keep). Counts a batch once, after it is stored."""
        if self.store.has(batch_id, stream):
            return
        if "seq" not in lines.columns:
            lines = lines.withColumn("seq", F.monotonically_increasing_id())
        rows = judged(given(lines), self.store.chunks()).persist()
        try:
            good = rows.filter("status = 'accepted'")
            self.store.add_series(good)
            self.store.append(good, batch_id, stream)
            for r in counters(rows).collect():
                self.totals[r.status] += r.n
        finally:
            rows.unpersist()
        if now is not None:
            self.store.maintain(now, self.metrics_delay, self.stale_delay)

    def start(self, lines: DataFrame, checkpoint: str, clock: Callable[[], int] | None = None, **trigger) -> StreamingQuery:
        """Ingest a stream of lines; stop() of the query ends it. Batches are numbered by checkpoint: a new one is another stream to the store."""
        name = stream_name(lines.sparkSession, checkpoint)
        run = lambda df, batch_id: self.batch(df, batch_id, clock() if clock else None, name)
        return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives in the checkpoint's folder, made where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/tickloom-stream")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    with_name = fs.open(path)
    try:
        return with_name.readUTF()
    finally:
        with_name.close()
