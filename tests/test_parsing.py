import pytest
from pyspark.sql import functions as F

from tickloom.functions.parsing import format_put, graphite_to_put, parse_put

BAD = {
    "get m 1 2": "not put",
    "put m 1a 2": "timestamp",
    "put m 1.5 2": "timestamp",
    "put m 1 a0": "value",
    "put m 1 2 a": "tags",
    "put m 1 2 a=": "tags",
    "put m 1 2 =a": "tags",
    "put  m 1 2": "name",
    "put m 1": "fields",
    "put": "fields",
    "": "fields",
    "put m -1 2": "range",
    "put m 2147483648 2": "range",
    "put m 99999999999999999999 2": "timestamp",
}


@pytest.mark.parametrize("line,reason", BAD.items())
def test_bad_lines_get_a_reason(spark, line, reason):
    row = parse_put(spark.createDataFrame([(line,)], "value string")).first()
    assert (row.reject_reason, row.full_name, row.ts) == (reason, None, None)


def test_good_lines(spark):
    lines = ["put m 7201 2.5", "put m 7201 NaN b=1 a=2  a=2", "put m 0 1e3 k=v=1 ", "put m 1 -Infinity"]
    rows = parse_put(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.reject_reason for r in rows] == [None] * 4
    assert [r.full_name for r in rows] == ["m", "m a=2 b=1", "m k=v=1", "m"]
    assert [r.chunk_start for r in rows] == [7200, 7200, 0, 0]
    assert rows[2].tags[0].value == "v=1" and rows[1].val != rows[1].val


def test_white_space_at_the_ends_of_values(spark):
    rows = parse_put(spark.createDataFrame([("put m 1 2\r",), ("put m 1 \t2\t a=1",), ("put m 1\r 2",)], "value string")).collect()
    assert [(r.reject_reason, r.val) for r in rows] == [(None, 2.0), (None, 2.0), ("timestamp", None)]


def test_null_lines_and_other_columns(spark):
    row = parse_put(spark.createDataFrame([(None, 5)], "value string, seq long")).first()
    assert row.reject_reason == "fields" and row.seq == 5


def test_lines_and_back(spark):
    line = "put m 7201 2.5 a=2 b=1"
    p = parse_put(spark.createDataFrame([(line,)], "value string"))
    assert p.select(format_put(F.col("metric"), F.col("ts"), F.col("val"), F.transform("tags", lambda t: t["raw"]))).first()[0] == line


def test_graphite(spark):
    rows = spark.createDataFrame([("a.b 1.5 77",), ("a.b 1.5",), ("a b c d",)], "value string").select(graphite_to_put(F.col("value"))).collect()
    assert [r[0] for r in rows] == ["put a.b 77 1.5 ", None, None]
