"""Queries over series and points: chunk pruning, series selection, merging with last-write-wins, and summing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunk_start, overlaps
from ..functions.matching import selects
from ..plans.model import Query, QueryAggregation


def points_of(points: DataFrame, q: Query, first: int | None = None, last: int | None = None) -> DataFrame:
    """The points of the selected series in the chunks that meet the range, for points that carry metric and tags: one
    scan, no join."""
    found = points.filter(selects(q))
    return found if first is None else found.filter(overlaps(F.col("chunk_start"), first, last))


def written(points: DataFrame) -> Column:
    """The order in which points were written: by ``seq``, in a store by write first."""
    return F.struct("write", "seq") if "write" in points.columns else F.col("seq")


def dedup(points: DataFrame, *by: str) -> DataFrame:
    """Of points of one series and time, the last that was written. An aggregation with partial results, not a window."""
    return points.groupBy(*(by or ("full_name",)), "ts").agg(F.max_by("val", written(points)).alias("val"))


def zimsum(points: DataFrame) -> DataFrame:
    """The sum of values by time over all series; points written twice count twice."""
    return points.groupBy("ts").agg(F.sum("val").alias("val"))


def nested(points: DataFrame, *by: str) -> DataFrame:
    """One row for each series and chunk, its points (ts, val) sorted by time: a row's size doesn't grow with the range."""
    start = chunk_start(F.col("ts"))
    return points.groupBy(*(by or ("full_name",)), start.alias("chunk_start")).agg(F.array_sort(F.collect_list(F.struct("ts", "val"))).alias("points"))


def left_series(series: DataFrame, points: DataFrame, q: Query, first: int, last: int) -> DataFrame:
    """(full_name, ts, val) with all selected series: one without points in the range has a row of nulls. Spark picks the join;
    a selection under its broadcast threshold is broadcast."""
    matched = series.filter(selects(q)).select("series_id", "full_name")
    own = dedup(points.filter(overlaps(F.col("chunk_start"), first, last)), "series_id")
    return matched.join(own, "series_id", "left").select("full_name", "ts", "val")


def query(series: DataFrame, points: DataFrame, q: Query, first: int, last: int, agg: QueryAggregation = QueryAggregation.NONE, *, trim: bool = False, drop_empty: bool = False) -> DataFrame:
    """(metric, ts, val): the points of a query's series, a row each, chunk by chunk: points of a chunk that meets the range belong to the
    result even where they are outside of it, unless ``trim``. A series without points is one row of nulls, unless ``drop_empty``; where no
    chunk meets the range there is no series either. ZIMSUM gives one series, also one row of nulls without points."""
    met = points.filter(overlaps(F.col("chunk_start"), first, last))
    window = met.filter(F.col("ts").between(first, last)) if trim else met
    matched = series.filter(selects(q)).select("series_id", "full_name")
    if agg is QueryAggregation.ZIMSUM:
        total = zimsum(window.join(matched, "series_id", "left_semi"))
        name = F.lit(f"zimsum {q.label}").alias("metric")
        one = points.sparkSession.range(1).select(name)
        return one.join(total.select(name, "ts", "val"), "metric", "left")
    found = dedup(window, "series_id")
    if drop_empty:
        return matched.join(found, "series_id").select(F.col("full_name").alias("metric"), "ts", "val")
    out = matched.filter(met.select(F.lit(1)).exists()).join(found, "series_id", "left")
    return out.select(F.col("full_name").alias("metric"), "ts", "val")


def chunk_query(series: DataFrame, points: DataFrame, q: Query, start: int) -> DataFrame:
    """(full_name, ts, val, seq) in one chunk as written: points written twice stand twice."""
    matched = series.filter(selects(q)).select("series_id", "full_name")
    return points.filter(F.col("chunk_start") == start).select("series_id", "ts", "val", "seq").join(matched, "series_id").select("full_name", "ts", "val", "seq")
