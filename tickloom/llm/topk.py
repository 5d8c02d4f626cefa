"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are scaled to integers. Query rows and candidate rows are dealt into blocks, and every candidate block meets
every query block in a cogroup: a stated query set against all rows. A candidate block is held as postings: for each
dimension (term) the rows with a weight that isn't zero. Every term of a query scatters its weight times the
postings into a dense array of scores; a partial selection keeps the k best of the block, ties to the smaller id. The k
best of all blocks merge by a window with a limit, which Spark applies before the shuffle too.

Scores are 64-bit integers; 32-bit where the largest weights prove that enough.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part;
an empty vector scores 0 with any; of vectors of unequal lengths the common terms count; a query with no candidate
returns no row; rows that repeat an id are not candidates of that id's queries, and equal query rows count
once (results of one query id are merged); weights beyond a long saturate as Spark's casts do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def best(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of each query row; q and c hold integer weights by row."""
    terms = min(q.shape[1], c.shape[1])
    bound = float(np.abs(q[:, :terms].astype(float)).max(initial=0)) * float(np.abs(c[:, :terms].astype(float)).max(initial=0)) * terms
    kind = np.int32 if bound < 2**31 else np.int64
    order = np.argsort(cids, kind="stable")  # then the first of equal scores has the smallest id
    cids, c, q = cids[order], c[order], q.astype(kind)
    postings = []
    for t in range(terms):
        rows = np.flatnonzero(c[:, t])
        postings.append((slice(None) if len(rows) == len(cids) else rows, c[rows, t].astype(kind)))
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(qids), 64):
        part, ids = q[at : at + 64], qids[at : at + 64]
        scores = np.zeros((len(ids), len(cids)), kind)
        for t, (rows, weights) in enumerate(postings):
            holds = np.flatnonzero(part[:, t])
            if not len(holds) or not len(weights):
                continue
            if not isinstance(rows, slice):
                scores[np.ix_(holds, rows)] += part[holds, t, None] * weights
            elif len(holds) == len(ids):
                scores += part[:, t, None] * weights
            else:
                scores[holds] += part[holds, t, None] * weights
        for i, own in enumerate(ids):
            a, b = np.searchsorted(cids, own), np.searchsorted(cids, own, "right")
            mine, names = (np.delete(scores[i], slice(a, b)), np.delete(cids, slice(a, b))) if b > a else (scores[i], cids)
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                above = np.flatnonzero(mine > least)
                keep = np.concatenate((above, np.flatnonzero(mine == least)[: k - len(above)]))
            else:
                keep = np.arange(len(mine))
            out[0].append(np.full(len(keep), own))
            out[1].append(names[keep])
            out[2].append(mine[keep].astype(np.int64))
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows end in zeros."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def topk_search(queries: DataFrame, candidates: DataFrame, k: int = 5, *, query_block: int = 1024, candidate_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) for query and candidate rows of (id long, v array<long>)."""
    spark = queries.sparkSession
    n = shuffle_partitions(spark)
    nq, nc = 1 + queries.count() // query_block, max(n, 1 + candidates.count() // candidate_block)
    number = F.monotonically_increasing_id()
    q = queries.dropDuplicates(["id", "v"]).select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = candidates.select("id", "v", F.pmod(number, F.lit(nc)).cast("int").alias("cb")).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "cb")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best(a["id"].to_numpy(), matrix(a["v"]), b["id"].to_numpy(), matrix(b["v"]), k) if a.num_rows and b.num_rows else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    q, c = (x.repartition(2 * n, "qb", "cb").groupBy("qb", "cb") for x in (q, c))
    found = q.cogroup(c).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(embeddings: DataFrame, scale: int = 256, every: int = 50, k: int = 5) -> DataFrame:
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding"), scale).alias("v"))
    return topk_search(rows.filter(F.col("id") % every == 0), rows, k)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_table(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
