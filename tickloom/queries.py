"""The registered queries of the library's operators, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunks import chunk_end, data_set
from .functions.parsing import clean_tags, format_put, graphite_to_put, parse_put
from .operators import catalog, codec, lifecycle, select, stats
from .plans.model import MAX_TS, Query, QueryAggregation, TagMatcher
from .sources import views
from .streaming.ingest import counters, judged

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

DAY = 1704067200  # 2024-01-01T00:00:00Z, the first of the events
NOW = DAY + 10 * 86400 + 4000
CLICK, TOTAL, PRICE = "event.click", "orders.total", "lineitem.price"

EVENTS = """events_ AS (SELECT 'event.' || event_type AS metric, CAST(user_id AS VARCHAR) AS usr, json_extract_string(props, '$.k') AS k,
  'event.' || event_type || ' user=' || user_id AS full_name, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value AS val, event_id AS seq FROM events),
e AS (SELECT *, ts - ts % 7200 AS chunk_start FROM events_)"""
ORDERS = """orders_ AS (SELECT 'orders.total' AS metric, replace(o_orderpriority, ' ', '_') AS priority, o_orderstatus AS status,
  'orders.total priority=' || replace(o_orderpriority, ' ', '_') || ' status=' || o_orderstatus AS full_name,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_totalprice AS val, o_orderkey AS seq FROM orders),
o AS (SELECT *, ts - ts % 7200 AS chunk_start FROM orders_)"""
ITEMS = """items_ AS (SELECT 'lineitem.price flag=' || l_returnflag || ' status=' || l_linestatus AS full_name, l_returnflag AS flag, l_linestatus AS status,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_extendedprice AS val, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
l AS (SELECT *, ts - ts % 7200 AS chunk_start FROM items_)"""


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def picked(name: str, view: Run, q: Query, sql_table: str, where: str, first: int | None = None, last: int | None = None) -> None:
    """Register the de-duplicated points of a query as ``name``; ``where`` is its filter in SQL."""
    cte = {"e": EVENTS, "o": ORDERS}[sql_table]
    span = "" if first is None else f" AND chunk_start <= {last} AND chunk_start + 7200 >= {first}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.dedup(select.points_of(view(spark, sf_dir, q, first, last), q, first, last)).select("full_name", "ts", "val")

    QUERIES[name] = run
    SQL[name] = f"WITH {cte} SELECT full_name, ts, arg_max(val, seq) AS val FROM {sql_table} WHERE {where}{span} GROUP BY full_name, ts"


M = TagMatcher
click, total = f"metric = '{CLICK}'", f"metric = '{TOTAL}'"
picked("q_metric", views.events, Query(CLICK), "e", click)
picked("q_exact", views.events, Query(CLICK, (M.exact("user", "42"),)), "e", f"{click} AND usr = '42'")
picked("q_has_key", views.events, Query.parse(f"{CLICK} user=*"), "e", click)
picked("q_wildcard", views.events, Query(CLICK, (M.wildcard("user", "1*"),)), "e", f"{click} AND usr LIKE '1%'")
picked("q_wildcard_infix", views.orders, Query(TOTAL, (M.wildcard("priority", "*-N*IFI*"),)), "o", f"{total} AND strpos(priority, '-N') > 0 AND strpos(substr(priority, 3), 'IFI') > 0")
picked("q_iwildcard", views.orders, Query(TOTAL, (M.wildcard("priority", "*uRG*", True),)), "o", f"{total} AND strpos(lower(priority), 'urg') > 0")
picked("q_literal_or", views.orders, Query(TOTAL, (M.literal_or("priority", "|1-URGENT|5-LOW|"),)), "o", f"{total} AND priority IN ('1-URGENT', '5-LOW')")
picked("q_iliteral_or", views.orders, Query(TOTAL, (M.literal_or("priority", "1-urgent|2-High", True),)), "o", f"{total} AND lower(priority) IN ('1-urgent', '2-high')")
picked("q_not_literal_or", views.orders, Query(TOTAL, (M.not_literal_or("status", "F|O"),)), "o", f"{total} AND status NOT IN ('F', 'O')")
picked("q_not_iliteral_or", views.orders, Query(TOTAL, (M.not_literal_or("priority", "1-urgent|3-medium", True),)), "o", f"{total} AND lower(priority) NOT IN ('1-urgent', '3-medium')")
picked("q_not_mixed", views.events, Query(CLICK, (M.wildcard("user", "*"), M.not_literal_or("k", "1|2"))), "e", click)
picked("q_multi_not", views.orders, Query(TOTAL, (M.not_literal_or("priority", "1-URGENT|2-HIGH"), M.not_literal_or("status", "F"))), "o", f"{total} AND NOT (priority IN ('1-URGENT', '2-HIGH') AND status = 'F')")
picked("q_regexp", views.orders, Query(TOTAL, (M.regexp("priority", "[1-3]-(U|M)"),)), "o", f"{total} AND regexp_matches(priority, '[1-3]-(U|M)')")
picked("q_mixed", views.orders, Query(TOTAL, (M.regexp("priority", "^[1-4]"), M.literal_or("status", "F|O"))), "o", f"{total} AND regexp_matches(priority, '^[1-4]') AND status IN ('F', 'O')")
picked("q_time_range", views.events, Query(CLICK), "e", click, DAY + 7200, DAY + 14400)
picked("q_none", views.events, Query(CLICK, (M.wildcard("user", "*"),)), "e", click)


@query(f"""WITH {ITEMS} SELECT full_name, ts, val FROM l
QUALIFY row_number() OVER (PARTITION BY full_name, ts ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, val DESC) = 1""")
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.dedup(select.points_of(views.lineitems(spark, sf_dir, Query(PRICE)), Query(PRICE)))


FIRST, LAST = DAY, DAY + 31 * 86400  # all of the events


@query(f"""WITH {EVENTS} SELECT s.full_name, p.ts, p.val FROM (SELECT DISTINCT full_name FROM e WHERE {click}) s LEFT JOIN
  (SELECT full_name, ts, arg_max(val, seq) AS val FROM e WHERE chunk_start <= {LAST} AND chunk_start + 7200 >= {FIRST} GROUP BY full_name, ts) p USING (full_name)""")
def q_left_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.with_ids(views.events(spark, sf_dir))
    return select.left_series(catalog.series_of(points), points, Query(CLICK), FIRST, LAST)


@query(f"WITH {EVENTS} SELECT ts, round(sum(val), 4) AS val FROM e WHERE {click} GROUP BY ts")
def q_zimsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.zimsum(select.points_of(views.events(spark, sf_dir, Query(CLICK)), Query(CLICK))).select("ts", F.round("val", 4).alias("val"))


@query(f"WITH {ITEMS} SELECT ts, CAST(sum(CAST(val AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS val FROM l WHERE flag = 'R' GROUP BY ts")
def q_zimsum_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(PRICE, (M.exact("flag", "R"),))
    points = select.points_of(views.lineitems(spark, sf_dir, q), q)
    return points.groupBy("ts").agg(F.sum(F.col("val").cast("decimal(18,4)")).cast("decimal(28,4)").alias("val"))


@query(f"""WITH {EVENTS}, s AS (SELECT DISTINCT full_name FROM e WHERE {click} AND usr LIKE '1%'),
p AS (SELECT full_name, ts, arg_max(val, seq) AS val FROM e WHERE chunk_start <= {LAST} AND chunk_start + 7200 >= {FIRST} GROUP BY full_name, ts)
SELECT full_name AS metric, ts, val FROM s LEFT JOIN p USING (full_name)""")
def q_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of a query with their points, those without points too; flat, so that no row grows with the range."""
    points = views.with_ids(views.events(spark, sf_dir))
    return select.query(catalog.series_of(points), points, Query(CLICK, (M.wildcard("user", "1*"),)), FIRST, LAST)


@query(f"""WITH {EVENTS} SELECT full_name, chunk_start, string_agg(ts || ':' || n, ',' ORDER BY ts) AS points
FROM (SELECT full_name, chunk_start, ts, count(*) AS n FROM e WHERE {click} GROUP BY ALL) GROUP BY full_name, chunk_start""")
def q_nested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of each series and chunk in one row, with how many points each has."""
    q = Query(CLICK)
    n = views.events(spark, sf_dir, q).groupBy("full_name", "ts").agg(F.count(F.lit(1)).alias("val"))
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["ts"], p["val"])), ",")
    return select.nested(n).select("full_name", "chunk_start", text.alias("points"))


@query(f"WITH {EVENTS} SELECT 'zimsum {CLICK}' AS metric, ts, round(sum(val), 4) AS val FROM e WHERE {click} AND chunk_start <= {LAST} AND chunk_start + 7200 >= {FIRST} GROUP BY ts")
def q_zimsum_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.with_ids(views.events(spark, sf_dir))
    return select.query(catalog.series_of(points), points, Query(CLICK), FIRST, LAST, QueryAggregation.ZIMSUM).withColumn("val", F.round("val", 4))


@query(f"WITH {EVENTS} SELECT full_name, ts, val, seq FROM e WHERE {click} AND chunk_start = {DAY + 7200}")
def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.with_ids(views.events(spark, sf_dir))
    return select.chunk_query(catalog.series_of(points), points, Query(CLICK), DAY + 7200)


@query(f"WITH {EVENTS} SELECT metric, ts, val, seq FROM e WHERE full_name = '{CLICK} user=7'")
def get_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.events(spark, sf_dir, Query(CLICK, (M.exact("user", "7"),)))
    return points.filter(F.col("full_name") == f"{CLICK} user=7").select("metric", "ts", "val", "seq")


@query(f"WITH {EVENTS} SELECT DISTINCT full_name, metric FROM e WHERE full_name = '{CLICK} user=7'")
def get_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find(catalog.series_of(views.events(spark, sf_dir)), f"{CLICK} user=7").select("full_name", "metric")


@query(f"WITH {EVENTS} SELECT DISTINCT full_name, metric, 'user=' || usr AS raw FROM e")
def series_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.series_of(views.events(spark, sf_dir)).select("full_name", "metric", F.col("tags")[0]["raw"].alias("raw"))


@query(f"WITH {EVENTS} SELECT DISTINCT metric || ' k=' || k || ' user=' || usr AS full_name FROM e")
def series_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.events_k(spark, sf_dir)
    before = catalog.series_of(points.filter(F.col("ts") < DAY + 10 * 86400))
    return catalog.upsert(before, points).select("full_name")


@query(f"WITH {EVENTS} SELECT DISTINCT full_name, usr AS tag_value FROM e WHERE {click}")
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tag_values(catalog.series_of(views.events(spark, sf_dir)), CLICK, "user").select("full_name", "tag_value")


def _named(found: Callable[[DataFrame], DataFrame]) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = catalog.series_of(views.events(spark, sf_dir))
        return found(catalog.tag_index(series)).join(series, "series_id").select("full_name")

    return run


QUERIES["set_intersect"] = _named(lambda i: catalog.with_all(i, CLICK, "user=3"))
SQL["set_intersect"] = f"WITH {EVENTS} SELECT DISTINCT full_name FROM e WHERE {click} AND usr = '3'"
QUERIES["set_union"] = _named(lambda i: catalog.with_any(i, CLICK, "user=3"))
SQL["set_union"] = f"WITH {EVENTS} SELECT DISTINCT full_name FROM e WHERE {click} OR usr = '3'"
QUERIES["set_except"] = _named(lambda i: catalog.with_first_only(i, CLICK, "user=3"))
SQL["set_except"] = f"WITH {EVENTS} SELECT DISTINCT full_name FROM e WHERE {click} AND usr <> '3'"


PUT_SQL = """lines AS (SELECT event_id AS seq, CASE event_id % 9 WHEN 1 THEN 'get' ELSE 'put' END || ' event.' || event_type || ' ' ||
  CASE event_id % 7 WHEN 2 THEN 'x' ELSE '' END || CAST(floor(epoch(ts)) AS BIGINT) || ' ' || CAST(CAST(floor(value * 4) AS BIGINT) AS VARCHAR) ||
  CASE event_id % 5 WHEN 3 THEN 'a' ELSE '' END || ' user=' || user_id || CASE event_id % 11 WHEN 4 THEN ' =v' WHEN 5 THEN ' a=b=c' ELSE '' END AS value,
  event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(value * 4) AS BIGINT) AS v FROM events),
parsed AS (SELECT *, CASE WHEN seq % 9 = 1 THEN 'not put' WHEN seq % 11 = 4 THEN 'tags' WHEN seq % 7 = 2 THEN 'timestamp' WHEN seq % 5 = 3 THEN 'value' END AS reject_reason FROM lines)"""


def put_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put lines of all events, some of them spoilt."""
    e = views.table(spark, sf_dir, "events")
    n, ts = F.col("event_id"), views.seconds(F.col("ts")).cast("string")
    tail = F.when(n % 11 == 4, " =v").when(n % 11 == 5, " a=b=c").otherwise("")
    value = F.concat(
        F.when(n % 9 == 1, "get").otherwise("put"), F.lit(" event."), "event_type", F.lit(" "), F.when(n % 7 == 2, "x").otherwise(""), ts,
        F.lit(" "), F.floor(F.col("value") * 4).cast("string"), F.when(n % 5 == 3, "a").otherwise(""), F.lit(" user="), F.col("user_id").cast("string"), tail,
    )
    return e.select(value.alias("value"), n.alias("seq"))


@query(f"""WITH {PUT_SQL} SELECT seq, reject_reason, CASE WHEN reject_reason IS NULL THEN 'event.' || event_type || CASE seq % 11 WHEN 5 THEN ' a=b=c' ELSE '' END || ' user=' || user_id END AS full_name,
  CASE WHEN reject_reason IS NULL THEN t END AS ts, CASE WHEN reject_reason IS NULL THEN CAST(v AS DOUBLE) END AS val, CASE WHEN reject_reason IS NULL THEN t - t % 7200 END AS chunk_start FROM parsed""")
def parse_put_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_put(put_lines(spark, sf_dir)).select("seq", "reject_reason", "full_name", "ts", "val", "chunk_start")


QUERIES["parse_put"], SQL["parse_put"] = QUERIES.pop("parse_put_lines"), SQL.pop("parse_put_lines")


@query(f"WITH {PUT_SQL} SELECT CASE WHEN reject_reason IS NOT NULL THEN 'invalid' WHEN t - t % 7200 + 7200 <= {NOW - 900} THEN 'delayed' ELSE 'accepted' END AS status, count(*) AS n FROM parsed GROUP BY 1")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = lifecycle.chunks_of(views.events(spark, sf_dir)).withColumn("read_only", lifecycle.is_past(F.col("chunk_end"), NOW))
    return counters(judged(put_lines(spark, sf_dir), chunks))


@query("SELECT DISTINCT 'm ' || CASE WHEN o_orderstatus < replace(o_orderpriority, ' ', '_') THEN o_orderstatus || '=1 ' || replace(o_orderpriority, ' ', '_') || '=2' ELSE replace(o_orderpriority, ' ', '_') || '=2 ' || o_orderstatus || '=1' END AS full_name FROM orders")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    a, b = F.concat(F.lit(" "), "o_orderstatus", F.lit("=1\t")), F.concat(F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("=2"))
    return o.select(F.array_join(F.concat(F.array(F.lit("m")), clean_tags(F.array(a, b, a, F.lit(""), F.lit(None)))), " ").alias("full_name")).distinct()


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'put m.' || event_type || ' ' || CAST(floor(epoch(ts)) AS BIGINT) || ' ' || user_id || ' ' END AS line FROM events")
def graphite_to_put_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("m."), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit(" "), views.seconds(F.col("ts")).cast("string"), F.when(F.col("event_id") % 4 == 3, " more").otherwise(""))
    return views.table(spark, sf_dir, "events").select("event_id", graphite_to_put(line).alias("line"))


QUERIES["graphite_to_put"], SQL["graphite_to_put"] = QUERIES.pop("graphite_to_put_lines"), SQL.pop("graphite_to_put_lines")


@query(f"WITH {EVENTS} SELECT seq, 'put ' || metric || ' ' || ts || ' ' || CAST(floor(val * 4) AS BIGINT) || ' user=' || usr AS line FROM e")
def format_put_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.events(spark, sf_dir)
    return p.select("seq", format_put(F.col("metric"), F.col("ts"), F.floor(F.col("val") * 4), F.transform("tags", lambda t: t["raw"])).alias("line"))


QUERIES["format_put"], SQL["format_put"] = QUERIES.pop("format_put_lines"), SQL.pop("format_put_lines")


@query(f"WITH {EVENTS} SELECT seq, ts, chunk_start, chunk_start + 7200 AS chunk_end FROM e")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select("seq", "ts", "chunk_start", chunk_end(F.col("chunk_start")).alias("chunk_end"))


@query(f"WITH {EVENTS} SELECT chunk_start, chunk_start + 7200 AS chunk_end, 'ev_' || chunk_start AS data_set, count(*) AS points FROM e GROUP BY chunk_start")
def chunk_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.events(spark, sf_dir).groupBy("chunk_start").agg(F.count(F.lit(1)).alias("points"))
    return c.select("chunk_start", chunk_end(F.col("chunk_start")).alias("chunk_end"), data_set("ev", F.col("chunk_start")).alias("data_set"), "points")


@query(f"""WITH {EVENTS}, s AS (SELECT DISTINCT full_name, metric, usr FROM e),
t AS (SELECT full_name AS token FROM s UNION ALL SELECT metric FROM s UNION ALL SELECT 'user' FROM s UNION ALL SELECT 'user=' || usr FROM s),
z AS (SELECT token, count(*) AS size FROM t GROUP BY token)
SELECT 'IndexMapDistribution' AS stat, size AS bucket, count(*) AS n FROM z GROUP BY size
UNION ALL SELECT 'IndexMapSize', 0, count(*) FROM z UNION ALL SELECT 'MetricIdMapSize', 0, count(*) FROM s""")
def stats_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_stats(catalog.series_of(views.events(spark, sf_dir)))


@query(f"""WITH {EVENTS}, d AS (SELECT *, ts - coalesce(lag(ts) OVER w, chunk_start) AS d, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY full_name, chunk_start ORDER BY seq)),
dd AS (SELECT *, d - lag(d) OVER (PARTITION BY full_name, chunk_start ORDER BY seq) AS dod FROM d)
SELECT full_name, chunk_start, count(*) AS points, CAST(sum(CASE WHEN rn = 1 THEN 46 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12
  WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END) AS BIGINT) AS bits FROM dd GROUP BY full_name, chunk_start""")
def stats_ts_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timestamp_bits(views.events(spark, sf_dir), "full_name")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.pack_chunks(views.with_ids(views.events(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT full_name, chunk_start, ts, val FROM e")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = catalog.series_of(views.events(spark, sf_dir)).select("series_id", "full_name")
    return codec.unpack_chunks(_packed(spark, sf_dir)).join(series, "series_id").select("full_name", "chunk_start", "ts", "val")


BITS = SQL["stats_ts_bits"].removeprefix(f"WITH {EVENTS}, ")
SIZES = f"""{BITS.partition("SELECT full_name, chunk_start, count(*) AS points")[0].rstrip()}, b AS (SELECT full_name, chunk_start, count(*) AS points_{BITS.partition("count(*) AS points")[2]}),
s AS (SELECT full_name, chunk_start, points_ AS points_count, bits // 64 AS timestamps_data_length, 5 + 8 * ((bits + 63) // 64) AS timestamps_data_size FROM b),
store AS (SELECT chunk_start, 'MetricCount' AS stat, 0 AS bucket, count(*) AS n FROM s GROUP BY chunk_start
UNION ALL SELECT chunk_start, 'TimeStampSizeDistribution', timestamps_data_length, count(*) FROM s GROUP BY chunk_start, timestamps_data_length
UNION ALL SELECT chunk_start, 'TimeStampByteSize', 0, CAST(sum(timestamps_data_size) AS BIGINT) FROM s GROUP BY chunk_start)"""


@query(f"WITH {EVENTS}, {SIZES} SELECT * FROM s")
def stats_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.series_sizes(views.events(spark, sf_dir), "full_name")


@query(f"WITH {EVENTS}, {SIZES} SELECT * FROM store")
def stats_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.store_stats(stats_series(spark, sf_dir))


@query(f"""WITH {EVENTS}, {SIZES}, i AS (SELECT * FROM ({SQL["stats_index"]}))
SELECT chunk_start, 'metricStore_' || stat AS stat, bucket, n FROM store UNION ALL SELECT NULL, 'tagStore_' || stat, bucket, n FROM i""")
def stats_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stats_index(spark, sf_dir).withColumn("chunk_start", F.lit(None).cast("long"))
    both = stats_store(spark, sf_dir).withColumn("stat", F.concat(F.lit("metricStore_"), "stat")), index.withColumn("stat", F.concat(F.lit("tagStore_"), "stat"))
    return both[0].unionByName(both[1])


@query()
def stats_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that depend on packed values, by chunk."""
    p = _packed(spark, sf_dir)
    sizes = p.groupBy("chunk_start").agg(F.sum(stats.stream_size(F.col("val_bits"))).alias("ValuesByteSize"), F.sum(F.length("blob").cast("long")).alias("TimeSeriesByteSize"))
    spread = p.groupBy("chunk_start", F.floor(F.col("val_bits") / 64).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.unpivot("chunk_start", ["ValuesByteSize", "TimeSeriesByteSize"], "stat", "n").select("chunk_start", "stat", F.lit(0).cast("long").alias("bucket"), "n")
    return found.unionByName(spread.select("chunk_start", F.lit("ValueSizeDistribution").alias("stat"), "bucket", "n"))


@query("SELECT 'event.' || event_type AS metric, count(*) AS expected, count(*) AS actual, true AS ok FROM events GROUP BY 1")
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.with_ids(views.events(spark, sf_dir))
    series = catalog.series_of(points).select("series_id", "metric")
    return stats.integrity(points, codec.unpack_chunks(codec.pack_chunks(points)).join(series, "series_id"))


@query(f"""WITH {EVENTS} SELECT DISTINCT chunk_start, chunk_start + 7200 AS chunk_end, 'chunk_' || chunk_start AS data_set, false AS read_only,
  CASE WHEN chunk_start + 7200 <= {NOW - 21600} THEN 'dropped' WHEN chunk_start + 7200 <= {NOW - 900} THEN 'sealed' ELSE 'open' END AS state FROM e""")
def chunk_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_at(lifecycle.chunks_of(views.events(spark, sf_dir)), NOW)


@query(f"""WITH {EVENTS} SELECT seq, chunk_start, CASE WHEN chunk_start + 7200 <= {NOW - 900} AND chunk_start + 7200 > {NOW - 21600} THEN 'delayed' ELSE 'accepted' END AS status FROM e""")
def late_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.events(spark, sf_dir)
    chunks = lifecycle.maintained(lifecycle.chunks_of(points), NOW)
    return lifecycle.late_status(points.select("seq", "chunk_start"), chunks)


@query(f"WITH {EVENTS} SELECT full_name, ts, val, seq FROM e WHERE chunk_start + 7200 > {NOW - 21600}")
def retained_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lifecycle.cutoff(NOW, lifecycle.STALE_DELAY)
    return lifecycle.retained(views.events(spark, sf_dir, None, first, MAX_TS), NOW).select("full_name", "ts", "val", "seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated points of clicks by user."""
    return QUERIES["q_has_key"](spark, sf_dir)
