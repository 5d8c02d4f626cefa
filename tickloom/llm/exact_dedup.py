"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when their bytes are, after each run of ``[\\x20\\x09-\\x0D]`` became one space. Rows are written once with their normalised
text and its 64-bit hash, the key. Every distinct text has one entry in the index. Entries are made by an aggregation on
(key, text), which compares bytes and combines copies before the shuffle, so that a text with a third of all rows sends one row a task.

The directory starts with as many buckets as entries ask for on average, by the first bits of the key, and doubles as long as a bucket is
overfull: a bucket with more than ``bucket_entries`` entries is split by the next bit, unless all of them have one key. It is a table of (depth,
prefix); it is broadcast only up to ``BROADCAST`` buckets, which are counted. Through it each entry gets its bucket; owner tasks
take key ranges, number the entries under one key as a chain, and write them to the shared folder.

A row looks its bucket up in the directory, and in the bucket its key. A chain of one entry has the row's text, since rows and entries are
of the same texts. In longer chains the row's bytes are compared with the entries'.

Defined results: a null text counts as empty; in a group with null ids the smallest id that isn't null stays;
rows that repeat the smallest id of their group are all kept (they are the same document); an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions, table

BROADCAST = 65_536
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_entries: int) -> tuple[DataFrame, list[int]]:
    """((depth, prefix, bucket), the depths): the buckets of the keys; ``bucket`` is the first key of its range."""
    depth, parts, open_, made = max(0, (entries.count() // bucket_entries).bit_length() - 1), [], entries.select("key"), []
    while True:
        counts = open_.groupBy(prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        counts = materialise(counts, "dedup-directory")
        made.append(counts)
        full = (F.col("n") > bucket_entries) & (F.col("low") != F.col("high"))
        start = F.shiftleft("prefix", 64 - depth) if depth else F.col("prefix")
        parts.append(counts.filter(~full).select(F.lit(depth).alias("depth"), "prefix", start.alias("bucket")))
        split = counts.filter(full).select("prefix")
        if depth == 64 or split.isEmpty():
            break
        open_ = open_.withColumn("prefix", prefix(depth)).join(split, "prefix", "left_semi").select("key")
        depth += 1
    table = materialise(reduce(DataFrame.unionAll, parts), "dedup-directory")
    discard(*made)
    depths = sorted(r[0] for r in table.select("depth").distinct().collect())  # 65 at most
    return (F.broadcast(table) if table.count() <= BROADCAST else table), depths


def routed(rows: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` with the bucket of their key."""
    at = [F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in depths] or [F.struct(F.lit(0).alias("depth"), prefix(0).alias("prefix"))]
    places = rows.withColumn("at", F.explode(F.array(*at)) if len(at) > 1 else at[0])
    places = places.select(*rows.columns, F.col("at.depth").alias("depth"), F.col("at.prefix").alias("prefix"))
    return places.join(buckets, ["depth", "prefix"]).drop("depth", "prefix")


def entries_of(keyed: DataFrame) -> DataFrame:
    """An entry for each distinct text of rows of (id, key, norm)."""
    entries = keyed.groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return entries.select("key", "norm", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_entries: int = 65_536, hash_bits: int = 64) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, bucket, link) for each row; ``hash_bits`` under 64 forces chains, for tests."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    key = F.xxhash64("norm")
    keyed = materialise(rows.withColumn("key", key if hash_bits >= 64 else F.shiftleft(key, 64 - hash_bits)), "dedup-rows", compression="zstd")
    entries = materialise(entries_of(keyed).drop("norm"), "dedup-entries")
    buckets, depths = directory(entries, bucket_entries)
    chain = Window.partitionBy("bucket", "key")
    owned = routed(entries, buckets, depths).repartitionByRange(shuffle_partitions(spark), "key")
    owned = owned.withColumns({"link": F.row_number().over(chain.orderBy("keep_id", "text_sha256")), "chain": F.count(F.lit(1)).over(chain)})
    index = materialise(owned, "dedup-index")
    discard(entries)
    found = routed(keyed.select("id", "key"), buckets, depths).join(index.filter("chain = 1"), ["bucket", "key"])
    out = ["id", "keep_id", "group_size", "text_sha256", "bucket", "link"]
    found = found.select(*out)
    chained = index.filter("chain > 1")
    if not chained.isEmpty():
        own = keyed.join(chained.select("key").distinct(), "key", "left_semi")
        by_bytes = entries_of(own).join(chained.select("key", "text_sha256", "bucket", "link"), ["key", "text_sha256"])
        found = found.unionByName(own.join(by_bytes, ["key", "norm"]).select(*out))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "link")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with all their columns."""
    keep = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    same = docs["doc_id"].eqNullSafe(keep["doc_id"]) & (F.sha2(normalised(docs["text"]), 256) == keep["text_sha256"])
    return docs.join(keep, same, "left_semi")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(norm) AS text_sha256, norm FROM (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents))
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
