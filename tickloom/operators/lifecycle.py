"""Chunks over time: open, sealed, dropped, and open again for very late points.

The rules are functions of ``now`` over the chunk table (chunk_start, chunk_end, data_set, read_only); ``Store`` applies them to
partitioned Parquet, where a sealed chunk is compacted into files of its own and a registry, written anew for each change,
decides which files count. A chunk's flag changes only with a registry that names its written files.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunk_end, data_set
from ..plans.model import CHUNK_SECONDS, POINTS, SERIES
from .catalog import series_of

METRICS_DELAY, STALE_DELAY = 15 * 60, 6 * 60 * 60
KEEP = 10  # registries


def chunks_of(points: DataFrame, prefix: str = "chunk") -> DataFrame:
    """The chunk table of points, all open."""
    starts = points.select("chunk_start").distinct()
    return starts.select("chunk_start", chunk_end(F.col("chunk_start")).alias("chunk_end"), data_set(prefix, F.col("chunk_start")).alias("data_set"), F.lit(False).alias("read_only"))


def cutoff(now: int, delay: int) -> int:
    if now - delay <= 0:
        raise ValueError("the cutoff must be after the epoch")
    return now - delay


def is_stale(end: Column, now: int, stale_delay: int = STALE_DELAY) -> Column:
    return end <= cutoff(now, stale_delay)


def is_past(end: Column, now: int, metrics_delay: int = METRICS_DELAY) -> Column:
    return end <= cutoff(now, metrics_delay)


def state_at(chunks: DataFrame, now: int, metrics_delay: int = METRICS_DELAY, stale_delay: int = STALE_DELAY) -> DataFrame:
    """The chunks with the state a maintenance tick at ``now`` leaves them in; retention goes before sealing."""
    state = F.when(is_stale(F.col("chunk_end"), now, stale_delay), "dropped").when(F.col("read_only") | is_past(F.col("chunk_end"), now, metrics_delay), "sealed").otherwise("open")
    return chunks.withColumn("state", state)


def maintained(chunks: DataFrame, now: int, metrics_delay: int = METRICS_DELAY, stale_delay: int = STALE_DELAY) -> DataFrame:
    """The chunk table after a tick."""
    after = state_at(chunks, now, metrics_delay, stale_delay).filter(F.col("state") != "dropped")
    return after.withColumn("read_only", F.col("state") == "sealed").drop("state")


def late_status(batch: DataFrame, chunks: DataFrame) -> DataFrame:
    """The batch with ``status``: accepted, or delayed if its chunk is sealed. A dropped chunk isn't in the table: its points are accepted
    and open it again. The chunk table has a row for each two hours kept, so Spark broadcasts it."""
    sealed = chunks.select("chunk_start", F.col("read_only").alias("_sealed"))
    status = F.when(F.coalesce("_sealed", F.lit(False)), "delayed").otherwise("accepted")
    return batch.join(sealed, "chunk_start", "left").withColumn("status", status).drop("_sealed")


def retained(points: DataFrame, now: int, stale_delay: int = STALE_DELAY) -> DataFrame:
    """The points of chunks that aren't stale, by a literal bound on the partition column."""
    return points.filter(F.col("chunk_start") > cutoff(now, stale_delay) - CHUNK_SECONDS)


@dataclass
class Store:
    """Points in Parquet under ``root``, by chunk and write, and a registry of which writes of a chunk count.

    A registry is a small text file of its own, written through Spark; the highest numbered complete one counts, and the last ``KEEP`` stay.
    Readers that have an older one keep reading its files: a folder that no longer counts is deleted ``grace`` seconds later."""

    spark: SparkSession
    root: str
    prefix: str = "chunk"
    grace: int = 3600

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def registry(self) -> tuple[int, dict]:
        """(version, what counts): ``chunks``, chunk start -> its writes and whether it is sealed; ``batches``, the last batch of each stream;
        ``trash``, when folders ceased to count. An entry for each two hours kept: small by design."""
        done = sorted((int(f.getPath().getName()) for f in self._fs().globStatus(self._path("registry", "*")) or [] if self._fs().exists(self._path("registry", f.getPath().getName(), "_SUCCESS"))), reverse=True)
        if not done:
            return 0, {"chunks": {}, "batches": {}, "trash": []}
        held = json.loads(self.spark.read.text(f"{self.root}/registry/{done[0]:012d}").first()[0])
        return done[0], held | {"chunks": {int(k): v for k, v in held["chunks"].items()}}

    def _publish(self, version: int, held: dict, gone: list[str] = []) -> None:  # noqa: B006
        """Write the next registry, in which the folders ``gone`` don't count; delete what ceased to count long enough ago, and old registries."""
        now = time.time()
        due = [p for t, p in held["trash"] if t <= now - self.grace]
        held["trash"] = [[t, p] for t, p in held["trash"] if t > now - self.grace] + [[now, p] for p in gone]
        row = self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1)
        row.write.text(f"{self.root}/registry/{version + 1:012d}")
        for p in due:
            self._fs().delete(self._path(p), True)
        if version > KEEP:
            self._fs().delete(self._path("registry", f"{version - KEEP:012d}"), True)

    def chunks(self) -> DataFrame:
        rows = [(k, k + CHUNK_SECONDS, f"{self.prefix}_{k}", v["sealed"]) for k, v in sorted(self.registry()[1]["chunks"].items())]
        return self.spark.createDataFrame(rows, "chunk_start long, chunk_end long, data_set string, read_only boolean")

    def has(self, batch_id: int, stream: str = "") -> bool:
        """Whether a batch of a stream is in."""
        return batch_id <= self.registry()[1]["batches"].get(stream, -1)

    def append(self, points: DataFrame, batch_id: int | None = None, stream: str = "") -> DataFrame:
        """Add the points of chunks that aren't sealed; the others come back, delayed. A batch that is in already, as after a
        restart of its stream, isn't added again."""
        version, held = self.registry()
        if batch_id is not None and batch_id <= held["batches"].get(stream, -1):
            return points.limit(0)
        judged = late_status(points.select("series_id", "ts", "val", F.col("seq").cast("decimal(38,0)").alias("seq"), "chunk_start"), self.chunks())
        name = self._write(judged.filter("status = 'accepted'").drop("status"), version)
        for start in self._starts(name):
            held["chunks"].setdefault(start, {"writes": [], "sealed": False})["writes"].append(name)
        if batch_id is not None:
            held["batches"][stream] = batch_id
        self._publish(version, held)
        return judged.filter("status = 'delayed'").drop("status")

    def _write(self, points: DataFrame, version: int, *order: str) -> str:
        """Write a folder for each chunk, in files of a size that Spark's advice gives, however few chunks there are."""
        name = uuid.uuid4().hex
        rows = points if "write" in points.columns else points.withColumn("write", F.lit(version).cast("long"))
        # a name that isn't a constant to Spark, so that the writer's order by chunk and name is seen to hold in the order asked for
        rows = rows.withColumn("name", F.when(F.col("chunk_start").isNotNull(), name)).hint("rebalance", "chunk_start")
        (rows.sortWithinPartitions("chunk_start", "name", *order) if order else rows).write.mode("append").partitionBy("chunk_start", "name").parquet(f"{self.root}/data")
        return name

    def series(self) -> DataFrame:
        """The series table; it outlives the chunks."""
        try:
            return self.spark.read.schema(SERIES).parquet(f"{self.root}/series")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], SERIES)

    def add_series(self, batch: DataFrame) -> None:
        """Append the batch's series that aren't in the table."""
        known = self.series().select("series_id")
        series_of(batch).join(known, "series_id", "left_anti").write.mode("append").parquet(f"{self.root}/series")

    def _starts(self, name: str) -> list[int]:
        found = self._fs().globStatus(self._path("data", "chunk_start=*", f"name={name}")) or []
        return [int(f.getPath().getParent().getName().partition("=")[2]) for f in found]

    def points(self) -> DataFrame:
        """All points, in one scan; filters on chunk_start prune partitions."""
        paths = [f"{self.root}/{p}" for k, v in sorted(self.registry()[1]["chunks"].items()) for p in folders(k, v)]
        if not paths:
            return self.spark.createDataFrame([], POINTS)
        return self.spark.read.schema(POINTS).option("basePath", f"{self.root}/data").parquet(*paths).select(*POINTS.fieldNames())

    def seal(self, starts: list[int]) -> None:
        """Compact each chunk into files of its own, sorted by series, then mark it; the flag comes with the files or not at all."""
        version, held = self.registry()
        todo = [s for s in starts if s in held["chunks"] and not held["chunks"][s]["sealed"]]
        if not todo:
            return
        name = self._write(self.points().filter(F.col("chunk_start").isin(todo)), version, "series_id", "write", "seq")
        gone = [p for s in todo for p in folders(s, held["chunks"][s])]
        for s in todo:
            held["chunks"][s] = {"writes": [name], "sealed": True}
        self._publish(version, held, gone)

    def drop(self, starts: list[int]) -> None:
        """Forget chunks, and delete their files after ``grace``; chunks that aren't there are no error."""
        version, held = self.registry()
        gone = [p for s in starts if s in held["chunks"] for p in folders(s, held["chunks"][s])]
        if gone:
            held["chunks"] = {k: v for k, v in held["chunks"].items() if k not in set(starts)}
            self._publish(version, held, gone)

    def clean(self) -> None:
        """Delete what ceased to count long enough ago."""
        version, held = self.registry()
        if any(t <= time.time() - self.grace for t, _ in held["trash"]):
            self._publish(version, held)

    def maintain(self, now: int, metrics_delay: int = METRICS_DELAY, stale_delay: int = STALE_DELAY) -> tuple[int, int]:
        """A tick: drop what is stale, then seal what is past. Returns how many of each."""
        state = {r.chunk_start: (r.state, r.read_only) for r in state_at(self.chunks(), now, metrics_delay, stale_delay).collect()}
        stale = [k for k, (s, _) in state.items() if s == "dropped"]
        past = [k for k, (s, sealed) in state.items() if s == "sealed" and not sealed]
        self.drop(stale)
        self.seal(past)
        self.clean()
        return len(stale), len(past)

    def seal_all(self) -> None:
        self.seal(list(self.registry()[1]["chunks"]))


def folders(start: int, chunk: dict) -> list[str]:
    return [f"data/chunk_start={start}/name={n}" for n in chunk["writes"]]
