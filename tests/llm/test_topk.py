import math
import random

import numpy as np

from tickloom.llm.topk import best, search_table


def plain(rows, k=5):
    ok = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, [math.floor(256 * float(np.float32(x))) for x in v])
    out = {}
    for q in [i for i in ok if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)[:k]
        out |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(scores)}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in search_table(df).collect()}


def test_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(230)]
    rows += [(300, None), (301, [None] * 8), (302, [math.nan] * 8), (303, [math.inf] * 8), (350, [0.0] * 8), (400, [1e-9] * 8)]
    rows += [(i, [0.5] * 8) for i in range(500, 560)]  # ties
    assert run(spark, rows) == plain(rows)


def test_few_candidates_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1): (1, 256 * 512)}
    assert run(spark, [(0, [1.0])]) == {} and run(spark, [(1, [1.0])]) == {}
    assert spark.createDataFrame([], "vec_id long, embedding array<float>").transform(search_table).count() == 0


def test_large_weights_are_exact():
    q, c = np.array([[2**31, 3]]), np.array([[2**30, 1], [2**30, 2]])
    got = dict(zip(*(x.tolist() for x in best(np.array([9]), q, np.array([4, 2]), c, 5)[1:]), strict=True))
    assert got == {4: 2**61 + 3, 2: 2**61 + 6}
