"""Every query with SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tickloom.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(key, map(tuple, rows))) == sorted(key([r[i] for i in order]) for r in want.fetchall())


def test_flagship(spark):
    df = flagship(spark, SF)
    assert df.columns == ["full_name", "ts", "val"] and df.count() > 0


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("q_metric", ["EqualTo(event_type,click)"]),
        ("q_exact", ["EqualTo(event_type,click)", "EqualTo(user_id,42)"]),
        ("q_time_range", ["EqualTo(event_type,click)", "GreaterThanOrEqual(ts,2024-01-01T00:00", "LessThan(ts,2024-01-01T06:00"]),
        ("q_mixed", ["In(o_orderstatus, [F,O])"]),
        ("q_zimsum_dups", ["EqualTo(l_returnflag,R)"]),
        ("get_series", ["EqualTo(event_type,click)", "EqualTo(user_id,7)"]),
        ("retained_points", ["GreaterThanOrEqual(ts,2024-01-10T"]),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(QUERIES[name](spark, SF))
    scan = next(x for x in text.split("PushedFilters: ")[1:])
    assert all(p in scan for p in pushed), scan[:600]


@pytest.mark.parametrize("name", ["q_metric", "q_dedup", "q_zimsum"])
def test_the_last_point_is_found_by_hashing(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "HashAggregate" in text and "SortAggregate" not in text
