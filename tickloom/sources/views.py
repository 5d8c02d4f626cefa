"""Points from tables: events, line items and orders as metrics.

Points carry (full_name, metric, tags, ts, val, seq, chunk_start): the tags of a view are known, so selecting series is a filter on the
scan, and names are made of few columns without sorting.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunk_start
from ..functions.matching import alternatives, selects
from ..functions.parsing import series_id
from ..plans.model import CHUNK_SECONDS, MatchType, Query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def at(second: int) -> Column:
    return F.to_timestamp_ntz(F.lit(str(datetime.fromtimestamp(second, timezone.utc).replace(tzinfo=None))))


def narrowed(rows: DataFrame, q: Query | None, first: int | None, last: int | None, *, metric: str, named_by: str | None, tags: dict[str, Column], raw: dict[str, str], ts: str) -> DataFrame:
    """The rows of a query, by tests of the table's own columns, which reach the scan: the metric (``metric`` and the text of
    ``named_by``), tags whose values are the columns ``raw``, and the range of chunks."""
    if q is not None:
        if named_by is None:
            rows = rows.filter(F.lit(q.metric == metric))
        else:
            rows = rows.filter(F.col(named_by) == q.metric.removeprefix(metric)) if q.metric.startswith(metric) else rows.filter(F.lit(False))
        kinds = dict(rows.dtypes)
        for m in q.matchers:
            if m.key in raw and m.type in (MatchType.EXACT, MatchType.LITERAL_OR):
                values = [m.pattern] if m.type is MatchType.EXACT else alternatives(m.pattern, False)
                if kinds[raw[m.key]] != "string":
                    values = [int(v) for v in values if v.lstrip("-").isdecimal() and str(int(v)) == v]
                rows = rows.filter(F.col(raw[m.key]).isin(values) if values else F.lit(False))
        rows = rows.filter(selects(q, F.lit(q.metric), tags))
    if first is not None:
        low, high = sorted((first, last))
        rows = rows.filter((F.col(ts) >= at(max(0, low - CHUNK_SECONDS))) & (F.col(ts) < at(high + CHUNK_SECONDS)))
    return rows


def as_points(rows: DataFrame, metric: Column, tags: dict[str, Column], ts: Column, val: Column, seq: Column) -> DataFrame:
    """tags: in the order of their keys."""
    raw = {k: F.concat(F.lit(f"{k}="), v) for k, v in tags.items()}
    structs = [F.struct(F.lit(k).alias("key"), v.alias("value"), raw[k].alias("raw")) for k, v in tags.items()]
    out = rows.select(metric.alias("metric"), F.array(*structs).alias("tags"), F.concat_ws(" ", metric, *raw.values()).alias("full_name"), ts.alias("ts"), val.alias("val"), seq.alias("seq"))
    return out.withColumn("chunk_start", chunk_start(F.col("ts")))


def with_ids(points: DataFrame) -> DataFrame:
    return points.withColumn("series_id", series_id(F.col("full_name")))


def events(spark: SparkSession, sf_dir: str, q: Query | None = None, first: int | None = None, last: int | None = None, k: bool = False) -> DataFrame:
    """``k``: with a second tag, of many values. The points of a query's series and chunks only, where one is given."""
    tags = {"user": F.col("user_id").cast("string")}
    if k:
        tags = {"k": F.get_json_object("props", "$.k"), **tags}
    rows = narrowed(table(spark, sf_dir, "events"), q, first, last, metric="event.", named_by="event_type", tags=tags, raw={"user": "user_id"}, ts="ts")
    return as_points(rows, F.concat(F.lit("event."), "event_type"), tags, seconds(F.col("ts")), F.col("value"), F.col("event_id"))


def events_k(spark: SparkSession, sf_dir: str, q: Query | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    return events(spark, sf_dir, q, first, last, k=True)


def lineitems(spark: SparkSession, sf_dir: str, q: Query | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Prices by day: many points of one series and time, told apart by all their keys. ``seq`` is one number, so that the last point is found
    by hash aggregation: order and line first, then part and supplier (34 and 30 bits)."""
    tags = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}
    rows = narrowed(table(spark, sf_dir, "lineitem"), q, first, last, metric="lineitem.price", named_by=None, tags=tags, raw={"flag": "l_returnflag", "status": "l_linestatus"}, ts="l_shipdate")
    line, rest = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.shiftleft("l_partkey", 30) + F.col("l_suppkey")
    seq = (line.cast("decimal(18,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + rest.cast("decimal(20,0)")).cast("decimal(38,0)")
    return as_points(rows, F.lit("lineitem.price"), tags, seconds(F.col("l_shipdate")), F.col("l_extendedprice"), seq)


def orders(spark: SparkSession, sf_dir: str, q: Query | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    tags = {"priority": F.replace("o_orderpriority", F.lit(" "), F.lit("_")), "status": F.col("o_orderstatus")}
    rows = narrowed(table(spark, sf_dir, "orders"), q, first, last, metric="orders.total", named_by=None, tags=tags, raw={"status": "o_orderstatus"}, ts="o_orderdate")
    return as_points(rows, F.lit("orders.total"), tags, seconds(F.col("o_orderdate")), F.col("o_totalprice"), F.col("o_orderkey"))
