import pytest
from pyspark.sql import functions as F

from tickloom.functions.chunks import overlaps
from tickloom.functions.parsing import parse_put
from tickloom.operators import catalog, select, stats
from tickloom.plans.model import Query, QueryAggregation, TagMatcher

T0 = 1488499200  # begins a chunk
H2 = 7200


@pytest.fixture(scope="module")
def store(spark):
    lines = [
        f"put m {T0 + 1} 1 host=a", f"put m {T0 + 1} 2 host=a", f"put m {T0 + 1} 5 host=b", f"put m {T0 + H2 + 5} 3 host=a",
        f"put m {T0 + 3 * H2} 4 host=b", f"put other {T0 + 1} 9 host=a", f"put m {T0 + 9 * H2} 7 host=c",
    ]
    points = parse_put(spark.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "value string, seq long")).drop("value")
    return catalog.series_of(points), points


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.metric, r.ts or 0)):
        out.setdefault(r.metric, []).extend([] if r.ts is None else [(r.ts, r.val)])
    return out


def test_chunks_join_and_the_last_point_wins(store):
    assert got(select.query(*store, Query("m"), T0, T0 + H2)) == {"m host=a": [(T0 + 1, 2.0), (T0 + H2 + 5, 3.0)], "m host=b": [(T0 + 1, 5.0)], "m host=c": []}
    assert set(got(select.query(*store, Query("m"), T0, T0 + 1, drop_empty=True))) == {"m host=a", "m host=b"}


def test_results_go_by_chunk_unless_trimmed(store):
    q = Query("m", (TagMatcher.exact("host", "a"),))
    assert got(select.query(*store, q, T0 + 100, T0 + 101))["m host=a"] == [(T0 + 1, 2.0)]
    assert got(select.query(*store, q, T0, T0 + 101, trim=True))["m host=a"] == [(T0 + 1, 2.0)]
    assert got(select.query(*store, q, T0 + 2, T0 + H2 + 5, trim=True))["m host=a"] == [(T0 + H2 + 5, 3.0)]


def test_no_chunk_no_series(store):
    assert got(select.query(*store, Query("m"), 0, 1)) == {}


def test_zimsum_counts_repeated_points_and_is_one_series(store):
    assert got(select.query(*store, Query("m"), T0, T0 + 1, QueryAggregation.ZIMSUM)) == {"zimsum m": [(T0 + 1, 8.0)]}
    assert got(select.query(*store, Query("none"), T0, T0 + 1, QueryAggregation.ZIMSUM)) == {"zimsum none": []}
    assert got(select.query(*store, Query("m"), 0, 1, QueryAggregation.ZIMSUM)) == {"zimsum m": []}


def test_nested_rows_are_by_chunk(store):
    rows = select.nested(select.dedup(select.points_of(store[1], Query("m", (TagMatcher.exact("host", "a"),))))).orderBy("chunk_start").collect()
    assert [(r.chunk_start, [tuple(p) for p in r.points]) for r in rows] == [(T0, [(T0 + 1, 2.0)]), (T0 + H2, [(T0 + H2 + 5, 3.0)])]


def test_an_unknown_key_with_a_known_mapping(spark):
    from tickloom.functions.matching import matches

    tags = {"host": F.lit("a1")}
    row = spark.range(1).select(*[matches(m, tags).alias(str(k)) for k, m in enumerate((TagMatcher.exact("host", "a1"), TagMatcher.exact("no", "a1"), TagMatcher.wildcard("no", "*"), TagMatcher.wildcard("host", "a*"), TagMatcher.regexp("no", "a"), TagMatcher.literal_or("host", "b|a1")))]).first()
    assert list(row) == [True, False, False, True, False, True]


def test_a_chunk_as_written(store):
    rows = select.chunk_query(*store, Query("m", (TagMatcher.exact("host", "a"),)), T0).orderBy("seq").collect()
    assert [r.val for r in rows] == [1.0, 2.0]


@pytest.mark.parametrize(
    "first,last,meets",
    [(0, 99, 0), (0, 7200, 1), (7200, 7201, 1), (8000, 9000, 1), (14400, 20000, 1), (14401, 20000, 0), (0, 20000, 1), (9000, 8000, 1), (20000, 9000, 1), (20000, 0, 0)],
)
def test_overlap(spark, first, last, meets):
    assert spark.range(1).select(overlaps(F.lit(7200), first, last)).first()[0] == bool(meets)


def test_dedup_prefers_the_last_written(spark):
    rows = spark.createDataFrame([("s", 2, 1.0, 5), ("s", 1, 2.0, 4), ("s", 2, 3.0, 1), ("s", 2, 4.0, 6)], "full_name string, ts long, val double, seq long")
    assert sorted(map(tuple, select.dedup(rows).collect())) == [("s", 1, 2.0), ("s", 2, 4.0)]


def test_catalog(store):
    series, points = store
    assert catalog.upsert(series.filter("full_name <> 'm host=b'"), points).count() == series.count() == 4
    assert {r.tag_value for r in catalog.tag_values(series, "m", "host").collect()} == {"a", "b", "c"}
    index = catalog.tag_index(series)
    assert catalog.with_all(index, "m", "host=a").count() == 1
    assert catalog.with_any(index, "m", "host=a").count() == 4
    assert catalog.with_first_only(index, "m", "host=a").count() == 2
    assert catalog.find(series, "m host=a").count() == 1
    found = {(r.stat, r.bucket): r.n for r in stats.index_stats(series).collect()}
    assert found[("MetricIdMapSize", 0)] == 4 and found[("IndexMapSize", 0)] == 10


def test_literal_ranges_prune_partitions(spark, store, tmp_path):
    store[1].drop("tags", "reject_reason").write.partitionBy("chunk_start").parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).filter(overlaps(F.col("chunk_start"), T0, T0 + 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_start" in plan and rows.count() == 4
