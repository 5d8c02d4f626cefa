import math
import random

import numpy as np
import pytest

from tickloom.operators import codec, stats

H = 1488499200


@pytest.mark.parametrize("second,total", [(0, 47), (1, 55), (64, 55), (65, 58), (256, 58), (257, 62), (2048, 62), (2049, 82)])
def test_bits_of_two_timestamps(second, total):
    assert len(codec.timestamp_bits(np.array([H, H + second]))) == total


def test_bits_of_values():
    assert len(codec.value_bits(np.array([1.0]))) == 64
    assert len(codec.value_bits(np.array([1.0, 1.0]))) == 65
    assert len(codec.value_bits(np.array([0.0, -0.0]))) == 64 + 13 + 1  # they differ in the highest bit


def same(a, b):
    return a == b and math.copysign(1, a) == math.copysign(1, b) or (a != a and b != b)


def test_round_trips():
    rng = random.Random(5)
    special = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, 1.7976931348623157e308, 1.0, 1.0, 2.0]
    for n in (0, 1, 2, 3, 50):
        ts = [H + rng.randint(0, 100_000) for _ in range(n)]
        val = [rng.choice([*special, rng.random()]) for _ in range(n)]
        got = codec.unpack(codec.pack(np.array(ts, np.int64), np.array(val, float)))
        assert got[0] == ts and all(map(same, got[1], val))


def test_bad_bytes_and_ranges():
    blob = codec.pack(np.array([H, H + 1]), np.array([1.0, 2.0]))
    assert codec.unpack(blob[:-1]) is None and codec.unpack(b"") is None and codec.unpack(b"\0\0\0\5" + blob[4:]) is None
    for ts in ([-1], [2**31]):
        with pytest.raises(ValueError):
            codec.timestamp_bits(np.array(ts))


def test_packed_chunks(spark):
    rows = [(s, H, k, H + 7 * k % 60, float(k % 5)) for s in range(40) for k in range(30)]
    points = spark.createDataFrame(rows, "series_id long, chunk_start long, seq long, ts long, val double")
    packed = codec.pack_chunks(points).cache()
    assert packed.count() == 40
    back = codec.unpack_chunks(packed)
    assert sorted(map(tuple, back.select("series_id", "chunk_start", "seq", "ts", "val").collect())) == sorted(rows)
    native = {r.series_id: (r.points, r.bits) for r in stats.timestamp_bits(points).collect()}
    assert native == {r.series_id: (r.n, r.ts_bits) for r in packed.collect()}
