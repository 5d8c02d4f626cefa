"""Sources give put lines; what becomes of lines is the same for all."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import graphite_to_put, parse_put
from .thrift import decode_messages


def given(lines: DataFrame) -> DataFrame:
    """Lines without the empty ones. A null line is what a message becomes that can't be read: it stays, to be counted as invalid."""
    return lines.filter(F.col("value").isNull() | (F.col("value") != ""))


def in_order(*parts: tuple[Column, int]) -> Column:
    """A number that orders by several: (number, how many it is below), the first decides."""
    out = F.lit(0).cast("decimal(38,0)")
    for number, below in parts:
        out = (out * F.lit(below).cast("decimal(20,0)") + number.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def plain_path(path: Column) -> Column:
    """A file's address in one spelling: Spark writes one or three slashes after a scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+:)/+", "$1/")


class Source(ABC):
    @abstractmethod
    def lines(self, spark: SparkSession) -> DataFrame:
        """(value string, seq decimal): put lines in a total order."""

    def load(self, spark: SparkSession) -> DataFrame:
        return parse_put(given(self.lines(spark)))


class TextSource(Source):
    """Files of put lines, or of graphite lines. ``seq`` goes by file name and place in the file, however Spark packs files into tasks."""

    def __init__(self, path: str, graphite: bool = False):
        self.path, self.graphite = path, graphite

    def lines(self, spark: SparkSession) -> DataFrame:
        text = spark.read.text(self.path)
        files = spark.createDataFrame(list(enumerate(sorted(text.inputFiles()))), "rank long, path string").select("rank", plain_path(F.col("path")).alias("path"))
        rows = text.select("value", plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        seq = in_order((F.col("rank"), 10**8), (F.col("block"), 10**15), (F.col("n") % (1 << 33), 10**13))
        rows = rows.join(files, "path").select("value", seq.alias("seq"))
        return rows.withColumn("value", graphite_to_put(F.col("value"))).filter("value IS NOT NULL") if self.graphite else rows


class KafkaSource(Source):
    """A topic, or one partition of it, of serialised messages of put lines. ``seq`` goes by offset, place in the message and partition.
    Needs Spark's Kafka package on the class path."""

    def __init__(self, topic: str, bootstrap: str, partition: str = "", group: str = "", **options: str):
        for name, value in (("topic", topic), ("bootstrap servers", bootstrap)):
            if not value:
                raise ValueError(f"{name} must not be empty")
        where = {"assign": f'{{"{topic}":[{int(partition)}]}}'} if partition else {"subscribe": topic}
        self.options = {"kafka.bootstrap.servers": bootstrap, **where, **({"kafka.group.id": group} if group else {}), **options}

    def _decoded(self, raw: DataFrame) -> DataFrame:
        messages = raw.select(decode_messages("value").alias("m"), "partition", "offset")
        lines = messages.select("partition", "offset", F.posexplode_outer("m.messages").alias("k", "value"))
        return lines.select("value", in_order((F.col("offset"), 1), (F.coalesce("k", F.lit(0)), 10**10), (F.col("partition"), 10**8)).alias("seq"))

    def lines(self, spark: SparkSession) -> DataFrame:
        return self._decoded(spark.read.format("kafka").options(**self.options).load())

    def stream(self, spark: SparkSession) -> DataFrame:
        return self._decoded(spark.readStream.format("kafka").options(**self.options).load())
