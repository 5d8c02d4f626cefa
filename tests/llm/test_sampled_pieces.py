import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import sampled_pieces
from tickloom.llm.sampled_pieces import decode, decode_pieces, encode, encode_pieces, load, op9_sampled_pieces, pieces_stage, vocabulary

from .odd import odd_texts


@pytest.fixture(scope="module")
def small():
    """A vocabulary of a few pieces; the other bytes stand for themselves."""
    pieces = [None] * 256 + [p.encode() for p in (" ", "a", "b", "ab", "ba", "aba", " a", "bab", "é")]
    return vocabulary(pieces, list(range(256)), 0.7)


def ways(text, v):
    """All segmentations of a text with their weights, by plain recursion."""
    if not text:
        return {(): 1.0}
    out = {}
    single = {i for i in range(256, len(v.lp)) if piece(v, i) == text[:1]}
    for i in [*range(256, len(v.lp)), *([] if single else [text[0]])]:
        if text.startswith(p := piece(v, i)):
            for rest, w in ways(text[len(p) :], v).items():
                out[(i, *rest)] = w * math.exp(v.lp[i])
    return out


def piece(v, i):
    return v.flat[v.offsets[i] : v.offsets[i + 1]].tobytes()


def test_draws_have_the_lattices_shares(small):
    text, n = b"ababa", 20_000
    ids, offsets = encode([text] * n, np.arange(n, dtype=np.uint64), small)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False))
    want = ways(b" " + text, small)
    total = sum(want.values())
    assert set(got) <= set(want)
    for way, w in want.items():
        p = w / total
        assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4, way


def test_round_trips_of_the_public_file():
    v = load()
    texts = [(t or "").encode() for t in odd_texts()] + [b"\x00\xff\xfe", "▁▁ a▁".encode(), b"  lead and trail  ", b"\n\n", b"y" * 300]
    ids, offsets = encode(texts, np.arange(len(texts), dtype=np.uint64), v)
    assert decode(ids, offsets, v) == texts
    again = [encode([t], np.array([k], np.uint64), v)[0].tolist() for k, t in enumerate(texts)]
    assert again == [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]  # whatever else is in the batch


def test_words_of_equal_hashes_are_told_apart():
    texts = [b"gaaiaajdcadeaecb acfaedaaafaahaaa"]
    v = load()
    assert decode(*encode(texts, np.zeros(1, np.uint64), v), v) == texts


@pytest.mark.parametrize("alpha", [2.0, 3.0])
def test_small_weights(alpha):
    v = load(alpha=alpha)
    texts = [("x" * n + "é").encode() for n in (1, 20, 59, 60, 61, 700, 3000)]
    assert decode(*encode(texts, np.arange(7, dtype=np.uint64), v), v) == texts


@pytest.mark.parametrize("window", [7, 1 << 15])
def test_long_words_have_the_lattices_shares(small, monkeypatch, window):
    monkeypatch.setattr(sampled_pieces, "LONG", 3)
    monkeypatch.setattr(sampled_pieces, "WINDOW", window)
    text, n = b"ababaabbab", 4000
    want = ways(b" " + text, small)
    total = sum(want.values())
    ids, offsets = encode([text] * n, np.arange(n, dtype=np.uint64), small)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False))
    assert set(got) <= set(want)
    assert all(abs(got[way] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-3 for way, w in want.items())
    monkeypatch.setattr(sampled_pieces, "LONG", 1 << 11)
    same = encode([text] * n, np.arange(n, dtype=np.uint64), small)
    assert ids.tolist() == same[0].tolist()  # the same draws either way


def test_a_long_line_without_spaces():
    text = "".join(chr(0x4E00 + i * i % 5000) for i in range(150_000)).encode() + b"a b"
    v = load()
    ids, offsets = encode([text, b"c"], np.zeros(2, np.uint64), v)
    assert decode(ids, offsets, v) == [text, b"c"]


def test_frames(spark, docs_of):
    texts = odd_texts()
    docs = docs_of(texts)
    a, b = encode_pieces(docs), encode_pieces(docs.repartition(7))
    first = {r.doc_id: r.pieces for r in a.collect()}
    assert first == {r.doc_id: r.pieces for r in b.collect()}
    assert first[0] is None and first[1] == []
    assert {r.doc_id: r.text for r in decode_pieces(a).collect()} == dict(enumerate(texts))
    assert pieces_stage(spark, docs, "").columns == ["doc_id", "pieces"]
    assert encode_pieces(docs.limit(0)).count() == 0


def test_seeds_change_the_draw(docs_of):
    docs = docs_of(["some words that have many pieces " * 5])
    assert len({tuple(encode_pieces(docs, alpha=0.2, seed=s).first().pieces) for s in range(4)}) == 4


def test_query(spark, docs_of, tmp_path):
    texts = odd_texts()
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op9_sampled_pieces(spark, str(tmp_path)).collect()}
    assert all(r.lossless for r in rows.values()) and len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].decoded_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())
