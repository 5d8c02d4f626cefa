import hashlib
import random

import numpy as np
import pytest

from tickloom.llm import bundles, repeats
from tickloom.llm.repeats import op6_repeats, pieces, remove_repeats, windows
from tickloom.llm.run_index import RunIndex

from .odd import odd_texts


def plain(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone, own = np.zeros(len(data), bool), set()
        for p in range(len(data) - 49):
            own.add(x := data[p : p + 50])
            if x in seen:
                gone[p : p + 50] = True
        seen |= own
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh  é") for _ in range(n))
    common, texts = [make(60), make(200), make(49), make(50)], odd_texts()
    for _ in range(120):
        parts = [make(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(common))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "Z"
            parts += ["".join(p), make(rng.randint(0, 40))]
        texts.append("".join(parts))
    texts += ["ab" * 200, "xab" + "ab" * 100, "q" * 49, "q" * 50]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot_texts,part,most", [(8192, 1 << 21, 8 << 20), (2, 100, 500), (5, 1000, 50)])
def test_against_a_plain_version(docs_of, monkeypatch, hot_texts, part, most):
    monkeypatch.setattr(repeats, "bundled", lambda *a, **k: bundles.bundled(*a, most=most, **k))
    texts = passages()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs_of(texts), hot_texts=hot_texts, part=part).collect()}
    want = plain(texts)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_texts_with_equal_polynomial_hashes(docs_of):
    texts = [x + "ecidpopmgdpamnaoihdkaaaamgna hophl" for x in ("gaaiaajdcadeaecb", "acfaedaaafaahaaa")]
    assert [r.n_removed for r in remove_repeats(docs_of(texts)).collect()] == [0, 0]


@pytest.mark.parametrize("size", [60, 3000])
def test_a_window_holds_each_string_once(monkeypatch, size):
    monkeypatch.setattr(repeats, "CHUNK", size)
    text = ("abc " * 30 + "the quick brown fox jumps over the lazy dog again and again").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    found = [(s + at, n) for _, at, own, ends in pieces(data, offsets) for s, n in zip(*windows(own, ends)[1:3], strict=True)]
    assert [p for s, n in found for p in range(s, s + n - 49)] == list(range(len(text) - 49))
    assert max(n for _, n in found) <= 82


def test_the_index_against_a_plain_version():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab ") for _ in range(200))
    texts = [base[(a := rng.randrange(120)) : a + rng.randrange(45, 80)] for _ in range(80)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    index, first = RunIndex(np.frombuffer(b"".join(texts), np.uint8), offsets), {}
    strings = [t[i : i + 50] for t in texts for i in range(len(t) - 49)]
    for k, x in enumerate(strings):
        first.setdefault(x, k)
    assert index.stream().tolist() == [first[x] for x in strings]
    assert index.runs < len(strings)
    ends = np.append(index.starts[1:], index.n) - 1
    assert [strings[k] for k in index.samples] == [sorted(strings)[e] for e in ends]


def test_the_index_of_nothing():
    assert RunIndex(np.zeros(0, np.uint8), np.zeros(1, np.int64)).stream().tolist() == []


def test_ids(spark):
    p = "a passage that is longer than fifty bytes, to be found again in others "
    rows = [(5, p), (5, p + "x"), (None, p), (2, None)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, len(p)), (2, 0), (5, 0), (5, 0)]
    rows = [(2**63 - 1, p), (None, p), (-(2**63), "x")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: 0, None: len(p), -(2**63): 0}


def test_text_and_empty(spark, docs_of, tmp_path):
    rows = {r.doc_id: r.kept_text for r in remove_repeats(docs_of(["ab" * 40, "x" + "ab" * 40 + "y"]), with_text=True).collect()}
    assert rows == {0: b"ab" * 40, 1: b"xy"}
    docs_of(["a"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_repeats(spark, str(tmp_path)).count() == 0
