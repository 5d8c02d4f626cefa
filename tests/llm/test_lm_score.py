import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lm_score
from tickloom.llm.context_tree import DECISIONS, keys_of, ln_gamma, mixed, summed, tree
from tickloom.llm.lm_score import op5_lm_score

from .odd import odd_texts


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def test_ln_gamma():
    x = np.concatenate((np.arange(1, 40) / 2, [1e3 + 0.5, 1e6]))
    assert np.allclose(ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


class Plain:
    """The tree of one bit decision after another, with dictionaries and recursion. A symbol's bits: whether it is the end, then the byte's."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            for context, bits in self.walk(t):
                for j, bit in enumerate(bits):
                    for d in range(depth + 1):
                        self.n[context[:d], bits[:j], bit] += 1
        self.contexts = {k[:2] for k in self.n}
        self.memo = {}

    def walk(self, text):
        full = bytes(self.depth) + text
        for i in range(self.depth, len(full) + 1):
            bits = f"0{full[i]:08b}" if i < len(full) else "1"
            yield full[i - self.depth : i][::-1], bits

    def kt(self, c, p):
        a, b = self.n[c, p, "0"], self.n[c, p, "1"]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(self, c, p):
        if len(c) == self.depth:
            return self.kt(c, p)
        if (c, p) not in self.memo:
            below = sum(self.pw(c + bytes([x]), p) for x in range(256) if (c + bytes([x]), p) in self.contexts)
            self.memo[c, p] = np.logaddexp(self.kt(c, p), below) - math.log(2)
        return self.memo[c, p]

    def score(self, text):
        total = 0.0
        for context, bits in self.walk(text):
            for j, bit in enumerate(bits):
                p, rest, last = 0.0, 1.0, 0.5
                for d in range(self.depth + 1):
                    c = context[:d]
                    if (c, bits[:j]) not in self.contexts:
                        break
                    last = (self.n[c, bits[:j], bit] + 0.5) / (self.n[c, bits[:j], "0"] + self.n[c, bits[:j], "1"] + 1)
                    stop = 1.0 if d == self.depth else math.exp(self.kt(c, bits[:j]) - self.pw(c, bits[:j])) / 2
                    p += rest * stop * last
                    rest *= 1 - stop
                total += math.log(p + rest * last)
        return total


def keys(texts, depth):
    return keys_of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=int))), depth)


def test_the_tree_against_a_plain_version():
    texts = [b"abracadabra", b"abra", b"\xff\x00ab", b""]
    for depth in (2, 5, 6):
        key, n = summed(own := keys(texts, depth), np.ones(len(own)))
        plain, trees = Plain(texts, depth), [tree(key, n, j, depth, 0) for j in range(DECISIONS)]
        for t in (b"abra", b"cad", b"zzz", b"", b"\0\0b"):
            assert mixed(keys([t], depth), depth, trees.__getitem__).sum() == pytest.approx(plain.score(t))


@pytest.mark.parametrize("bundle,shard,hot", [(16 << 20, 8 << 20, 256), (300, 100, 100), (5000, 50, 1000)])
def test_the_query_against_a_plain_version(spark, docs_of, tmp_path, monkeypatch, bundle, shard, hot):
    for name, value in (("BUNDLE", bundle), ("SHARD", shard), ("HOT_SHARE", hot), ("CHUNK", 400)):
        monkeypatch.setattr(lm_score, name, value)
    same_hash = ["gaaiaajdcadeaecb", "acfaedaaafaahaaa"]  # by a polynomial modulo 2 ** 64
    texts = [t for t in odd_texts() if not t or len(t) < 6000] + [f"Text {i % 9} of the {i % 4} kind, again" for i in range(60)] + same_hash + ["nul \0 in it \0"]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op5_lm_score(spark, str(tmp_path)).collect()}
    training = [lower(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in training for w in t.split())
    c[None] = len(training)
    n, v = sum(c.values()), len(c)
    plain = Plain(training, lm_score.DEPTH)
    for i, t in enumerate(texts):
        words = [*lower(t).split(), None]
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(words), sum(w in c for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score == pytest.approx(plain.score(lower(t)) / math.log(10), rel=1e-9)


def test_no_training_rows_and_no_rows(spark, docs_of, tmp_path):
    docs = docs_of(["abc", "d"])
    out = [i for i in range(2) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs.limit(0).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert op5_lm_score(spark, str(tmp_path / "a")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs_of(["abc"], held).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    row = op5_lm_score(spark, str(tmp_path / "b")).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score == pytest.approx(-(3 * 9 + 1) * math.log10(2)) and out is not None
