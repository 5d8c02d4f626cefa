"""The series table and its token index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import first_value, has_key
from ..functions.parsing import series_id


def series_of(points: DataFrame) -> DataFrame:
    """Each series once: (series_id, full_name, metric, tags). The name decides, so it is all that is grouped by."""
    return points.groupBy("full_name").agg(F.any_value("metric").alias("metric"), F.any_value("tags").alias("tags")).select(series_id(F.col("full_name")).alias("series_id"), "full_name", "metric", "tags")


def upsert(series: DataFrame, batch: DataFrame) -> DataFrame:
    """The series table with the batch's new series. Ids are hashes of names, so writers needn't agree on a counter."""
    new = series_of(batch).join(series.select("series_id"), "series_id", "left_anti")
    return series.unionByName(new)


def tag_index(series: DataFrame) -> DataFrame:
    """(token, series_id): a series under its name, its metric, its tag keys and its tags, each once."""
    tokens = F.array_distinct(F.concat(F.array("full_name", "metric"), F.transform("tags", lambda t: t["key"]), F.transform("tags", lambda t: t["raw"])))
    return series.select(F.explode(tokens).alias("token"), "series_id")


def tag_values(series: DataFrame, metric: str, key: str) -> DataFrame:
    return series.filter((F.col("metric") == metric) & has_key(key)).select("series_id", "full_name", first_value(key).alias("tag_value"))


def with_all(index: DataFrame, *tokens: str) -> DataFrame:
    """Series under all tokens: one aggregation over the index instead of a join for each token."""
    found = index.filter(F.col("token").isin(*tokens)).groupBy("series_id").agg(F.count_distinct("token").alias("n"))
    return found.filter(F.col("n") == len(set(tokens))).select("series_id")


def with_any(index: DataFrame, *tokens: str) -> DataFrame:
    return index.filter(F.col("token").isin(*tokens)).select("series_id").distinct()


def with_first_only(index: DataFrame, token: str, but: str) -> DataFrame:
    found = index.filter(F.col("token").isin(token, but)).groupBy("series_id").agg(F.max(F.col("token") == but).alias("gone"), F.max(F.col("token") == token).alias("held"))
    return found.filter("held AND NOT gone").select("series_id")


def find(series: DataFrame, full_name: str) -> DataFrame:
    return series.filter(F.col("series_id") == series_id(F.lit(full_name))).filter(F.col("full_name") == full_name)
