import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.functions.parsing import parse_put
from tickloom.operators import lifecycle, select
from tickloom.operators.lifecycle import Store
from tickloom.plans.model import Query
from tickloom.sources.base import KafkaSource, TextSource
from tickloom.sources.thrift import decode, decode_messages, encode
from tickloom.streaming.ingest import Ingest

T0, H2 = 1488499200, 7200


def points(spark, *at, start=0):
    rows = [(f"put m {T0 + x} {k} host=a", start + k) for k, x in enumerate(at)]
    return parse_put(spark.createDataFrame(rows, "value string, seq long"))


def states(spark, now, **delays):
    chunks = lifecycle.chunks_of(points(spark, 0, H2, 2 * H2))
    return [r.state for r in lifecycle.state_at(chunks, now, **delays).orderBy("chunk_start").collect()]


def test_states_by_time(spark):
    assert states(spark, T0 + H2 + 899) == ["open"] * 3
    assert states(spark, T0 + H2 + 900) == ["sealed", "open", "open"]
    assert states(spark, T0 + H2 + 21600) == ["dropped", "sealed", "sealed"]
    assert states(spark, T0 + 3 * H2, metrics_delay=0, stale_delay=14400) == ["dropped", "sealed", "sealed"]
    with pytest.raises(ValueError):
        lifecycle.cutoff(100, 100)


def test_a_store_through_its_life(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.points().count() == 0 and store.maintain(T0) == (0, 0)
    batch = points(spark, 1, 1, H2 + 1, 2 * H2 + 1)
    store.add_series(batch)
    store.add_series(batch)
    assert store.append(batch).count() == 0
    before = select.query(store.series(), store.points(), Query("m"), T0, T0 + 9 * H2).collect()
    assert store.maintain(T0 + H2 + 900) == (0, 1)
    assert store.maintain(T0 + H2 + 900) == (0, 0)
    assert select.query(store.series(), store.points(), Query("m"), T0, T0 + 9 * H2).collect() == before
    late = store.append(points(spark, 5, H2 + 5, start=10))
    assert [r.ts for r in late.collect()] == [T0 + 5]  # sealed: delayed
    assert store.points().count() == 5
    store.seal_all()
    assert store.chunks().filter("read_only").count() == 3
    assert store.maintain(T0 + H2 + 21600) == (1, 0)
    store.drop([T0, 12345])  # no error
    assert store.append(points(spark, 7, start=20)).count() == 0  # dropped: opens again
    assert store.chunks().filter(~F.col("read_only")).count() == 1
    assert store.maintain(T0 + H2 + 21600) == (1, 0)
    assert store.series().count() == 1


def test_a_batch_is_added_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        store.append(points(spark, 1, 2), batch_id=0)
    assert store.points().count() == 2


def test_batches_are_numbered_by_stream(spark, tmp_path):
    job = Ingest(Store(spark, str(tmp_path)))
    lines = lambda *v: spark.createDataFrame([(x, k) for k, x in enumerate(v)], "value string, seq long")
    job.batch(lines(f"put m {T0 + 1} 1"), 5, stream="a")
    job.batch(lines(f"put m {T0 + 2} 2", f"put m {T0 + 3} 3"), 0, stream="b")  # a fresh checkpoint
    job.batch(lines(f"put m {T0 + 2} 2", f"put m {T0 + 3} 3"), 0, stream="b")  # a retry
    job.batch(lines(f"put m {T0 + 4} 4"), 40_000, stream="a")
    job.batch(lines(None, "", "bad"), 1, stream="b")
    assert job.totals == {"accepted": 4, "delayed": 0, "invalid": 2} and job.store.points().count() == 4


def test_a_later_write_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = points(spark, 1, start=9)
    store.add_series(one)
    store.append(one)
    store.append(points(spark, 1, 1, start=0))
    for _ in range(2):
        assert [r.val for r in select.query(store.series(), store.points(), Query("m"), T0, T0 + 1).collect()] == [1.0]
        store.seal_all()


def data_folders(path):
    return sorted(p.parent.name for p in path.glob("data/chunk_start=*/name=*"))


def test_files_go_with_their_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path), grace=0)
    for k in range(3):
        store.append(points(spark, 1, H2 + 1, start=10 * k))
    assert len(data_folders(tmp_path)) == 6
    store.maintain(T0 + H2 + 900)  # seals the first chunk
    assert data_folders(tmp_path) == [f"chunk_start={T0}"] + [f"chunk_start={T0 + H2}"] * 3 and store.points().count() == 6
    store.maintain(T0 + H2 + 21600)
    assert data_folders(tmp_path) == [f"chunk_start={T0 + H2}"] and store.points().count() == 3
    kept = Store(spark, str(tmp_path / "b"), grace=3600)
    kept.append(points(spark, 1))
    kept.drop([T0])
    assert len(data_folders(tmp_path / "b")) == 1 and kept.points().count() == 0


def test_sealed_files_are_sorted_by_series(spark, tmp_path):
    store = Store(spark, str(tmp_path), grace=0)
    for k in range(3):
        lines = [(f"put m {T0 + i} {i} host=h{i * 7 % 50}", i) for i in range(200)]
        store.append(parse_put(spark.createDataFrame(lines, "value string, seq long")))
    store.seal_all()
    store.clean()
    files = list(tmp_path.glob("data/chunk_start=*/name=*/*.parquet"))
    for f in files:
        ids = pq.read_table(f)["series_id"].to_pylist()
        assert ids == sorted(ids)
    assert sum(pq.read_table(f).num_rows for f in files) == 600


def test_one_scan_and_few_registries(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(lifecycle.KEEP + 3):
        store.append(points(spark, 1, start=k))
    plan = store.points()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan and len(list((tmp_path / "registry").glob("0*"))) <= lifecycle.KEEP + 1


def test_streaming_files(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "a.txt").write_text(f"put m {T0 + 1} 1 host=a\nput m {T0 + 1} 2 host=a\nbad\n\nput m {T0 + H2} 3 host=b\n")
    job = Ingest(Store(spark, str(tmp_path / "store")))
    stream = lambda: spark.readStream.text(str(lines))
    job.start(stream(), str(tmp_path / "cp"), clock=lambda: T0 + H2 + 900).awaitTermination()
    assert job.totals == {"accepted": 3, "delayed": 0, "invalid": 1}
    (lines / "b.txt").write_text(f"put m {T0 + 2} 9 host=a\nput m {T0 + H2 + 1} 4 host=b\n")
    job.start(stream(), str(tmp_path / "cp"), clock=lambda: T0 + H2 + 900).awaitTermination()
    assert job.totals == {"accepted": 4, "delayed": 1, "invalid": 1}
    rows = select.query(job.store.series(), job.store.points(), Query("m"), T0, T0 + H2).collect()
    assert sorted((r.metric, r.ts - T0, r.val) for r in rows) == [("m host=a", 1, 2.0), ("m host=b", H2, 3.0), ("m host=b", H2 + 1, 4.0)]
    job.start(stream(), str(tmp_path / "new"), clock=lambda: T0 + H2 + 900).awaitTermination()  # reads all again, as another stream
    assert job.totals == {"accepted": 6, "delayed": 4, "invalid": 2}


def test_text_order_is_by_file(spark, tmp_path):
    (tmp_path / "b big.txt").write_text("".join(f"put m {T0} {k}\n" for k in range(2000)))
    (tmp_path / "a.txt").write_text(f"put m {T0} -1\n")
    (tmp_path / "c.txt").write_text(f"put m {T0} 5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = TextSource(str(tmp_path)).load(spark)
        assert [r.val for r in rows.orderBy("seq").collect()] == [-1.0, *map(float, range(2000)), 5.0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_kafka_order(spark):
    raw = spark.createDataFrame([(bytearray(encode(["x", "y"])), p, o) for p in (0, 7) for o in (3, 10**15)] + [(bytearray(b"junk"), 0, 4)], "value binary, partition int, offset long")
    rows = KafkaSource("t", "b:1")._decoded(raw).orderBy("seq").collect()
    assert len({r.seq for r in rows}) == 9 and [r.value for r in rows] == ["x", "x", "y", "y", None, "x", "x", "y", "y"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a.b 1.5 77\nnope\n\na.b 2.5 78\n")
    rows = TextSource(str(tmp_path / "x.txt"), graphite=True).load(spark).orderBy("seq").collect()
    assert [(r.metric, r.ts, r.val) for r in rows] == [("a.b", 77, 1.5), ("a.b", 78, 2.5)]


def test_messages(spark):
    good = encode(["put m 1 2", "put m 2 3"], host="h")
    assert decode(good) == {"messages": ["put m 1 2", "put m 2 3"], "host": "h", "filename": None}
    nested = b"\x0c\0\x09" * 5000 + b"\0" * 5001
    for bad in (None, b"", b"xyz", good[:-3], b"\0", nested):
        assert decode(bad) is None
    rows = spark.createDataFrame([(bytearray(good),), (bytearray(b"junk"),), (None,)], "value binary").select(decode_messages("value").messages.alias("m")).collect()
    assert [r.m for r in rows] == [["put m 1 2", "put m 2 3"], None, None]


def test_kafka_options():
    assert KafkaSource("t", "b:1", "3").options["assign"] == '{"t":[3]}'
    assert KafkaSource("t", "b:1").options["subscribe"] == "t"
    with pytest.raises(ValueError):
        KafkaSource("", "b:1")
