"""Statistics of the index, of chunks and of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import CHUNK_SECONDS
from .catalog import tag_index


def index_stats(series: DataFrame) -> DataFrame:
    """(stat, bucket, n): how many series and tokens there are, and how many tokens have ``bucket`` series."""
    sizes = tag_index(series).groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    spread = sizes.groupBy(F.col("size").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = series.agg(F.count(F.lit(1)).alias("n")).select(F.lit("MetricIdMapSize").alias("stat"), F.lit(0).cast("long").alias("bucket"), "n")
    tokens = spread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("IndexMapSize").alias("stat"), F.lit(0).cast("long").alias("bucket"), "n")
    return spread.select(F.lit("IndexMapDistribution").alias("stat"), "bucket", "n").unionByName(counts).unionByName(tokens)


def timestamp_width(delta_of_delta: Column) -> Column:
    """Bits of a timestamp after the first, by its delta of deltas."""
    d = delta_of_delta
    return F.when(d == 0, 1).when(d.between(-63, 64), 9).when(d.between(-255, 256), 12).when(d.between(-2047, 2048), 16).otherwise(36)


def timestamp_bits(points: DataFrame, *by: str) -> DataFrame:
    """(by, chunk_start, points, bits): size of the packed timestamps of each series and chunk, in the order of writing.

    The first takes 46 bits; the delta before the second counts from the chunk's start. Windows are by series and
    chunk, two hours of one series."""
    by = by or ("series_id",)
    w = Window.partitionBy(*by, "chunk_start").orderBy("seq")
    delta = F.col("ts") - F.coalesce(F.lag("ts").over(w), F.col("ts") - F.col("ts") % CHUNK_SECONDS)
    first = F.row_number().over(w) == 1
    x = points.select(*by, "chunk_start", "seq", "ts", delta.alias("d"), first.alias("first"))
    width = F.when(F.col("first"), 46).otherwise(timestamp_width(F.col("d") - F.lag("d").over(w)))
    return x.withColumn("bits", width).groupBy(*by, "chunk_start").agg(F.count(F.lit(1)).alias("points"), F.sum("bits").cast("long").alias("bits"))


def stream_size(bits: Column) -> Column:
    """Bytes of a packed stream of so many bits: a length, a shift, and whole words."""
    return F.lit(5) + 8 * F.ceil(bits / 64)


def series_sizes(points: DataFrame, *by: str) -> DataFrame:
    """(by, chunk_start, points_count, timestamps_data_length, timestamps_data_size) of each series and chunk."""
    bits = timestamp_bits(points, *by)
    return bits.select(*(by or ("series_id",)), "chunk_start", F.col("points").alias("points_count"), F.floor(F.col("bits") / 64).alias("timestamps_data_length"), stream_size(F.col("bits")).alias("timestamps_data_size"))


def store_stats(sizes: DataFrame) -> DataFrame:
    """(chunk_start, stat, bucket, n): how many series a chunk has, how many have timestamps of ``bucket`` words, and their bytes in all."""
    one = sizes.groupBy("chunk_start").agg(F.count(F.lit(1)).alias("MetricCount"), F.sum("timestamps_data_size").alias("TimeStampByteSize"))
    found = one.unpivot("chunk_start", ["MetricCount", "TimeStampByteSize"], "stat", "n").select("chunk_start", "stat", F.lit(0).cast("long").alias("bucket"), "n")
    spread = sizes.groupBy("chunk_start", F.col("timestamps_data_length").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(spread.select("chunk_start", F.lit("TimeStampSizeDistribution").alias("stat"), "bucket", "n"))


def integrity(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(metric, expected, actual, ok): points put in against points read back."""
    a = lines.groupBy("metric").agg(F.count(F.lit(1)).alias("expected"))
    b = found.groupBy("metric").agg(F.count(F.lit(1)).alias("actual"))
    both = a.join(b, "metric", "full").select("metric", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.withColumn("ok", F.col("expected") == F.col("actual"))
