import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm.quality import Network, contexts, features, fit, index_vectors, op8_quality, score, tokens, train, word_vectors

from .odd import odd_texts


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    parts, rows, labels = ["the", "ing", "th", "ou", "sh", "ea", "er"], [], []
    for i in range(700):
        good = rng.random() < 0.6
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        text = " ".join(words) if good else rng.choice([" ".join([words[0]] * 60), " | ".join(words), "!! ".join(w.upper() for w in words)])
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    labels += [(5, None, 0), (99_999, 1, 0)]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_tokens():
    texts = ["Ab ab, $$ x", "", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    slot, size, symbol, ends = tokens(data, np.array([0, 11, 11, 12]))
    assert size.tolist() == [2, 2, 1, 2, 1, 1] and symbol.tolist() == [False, False, True, True, False, False]
    assert slot[0] == slot[1] and slot[4] == slot[5] and ends.tolist() == [0, 5, 5, 6]


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    v = word_vectors(np.zeros((1 << 13, 48)), index_vectors())
    texts = [t or "" for t in odd_texts()]
    together = features(pa.array(texts), v)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(features(pa.array([t]), v)[0], row, atol=1e-5)


def plain_tokens(text):
    out = []
    for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode()):
        h, power = 0, 1
        for c in t.lower():  # ASCII only, on bytes
            h, power = (h + c * power) % 2**64, power * 0x9E3779B97F4A7C15 % 2**64
        out.append((((h ^ h >> 32) * 0x9E3779B97F4A7C15 % 2**64) >> 51, len(t), not re.match(rb"[0-9A-Za-z\x80-\xff]", t)))
    return out


def plain_features(text, vectors):
    found = plain_tokens(text)
    n = len(found)
    if not n:
        return [0.0] * 104
    v = [vectors[s].tolist() for s, _, _ in found]
    mean = [sum(x[d] for x in v) / n for d in range(48)]
    square = [math.sqrt(sum(x[d] ** 2 for x in v) / n) for d in range(48)]
    sizes = [k for _, k, _ in found]
    average, kinds = sum(sizes) / n, len({s for s, _, _ in found})
    repeats = sum(a[0] == b[0] for a, b in zip(found, found[1:], strict=False)) / n
    spread = math.sqrt(max(0.0, sum(k * k for k in sizes) / n - average**2))
    more = [math.log1p(n) / 5, math.sqrt(sum(x * x for x in mean)) * 2, sum(x for _, _, x in found) / n * 2, average / 5, repeats * 4, kinds / n, math.log1p(kinds) / 5, spread / 5]
    return [4 * x for x in mean] + square + more


def test_scores_against_a_plain_version(corpus):
    """From texts to scores: tokens, random indexing over all documents, pooling and the network, one number at a time."""
    docs, labels = corpus
    vectors, net = fit(docs, labels)
    rows, index = [r for r in docs.collect() if len(r.text or "") < 6000], index_vectors()
    every = docs.filter("length(text) < 6000 or text is null")
    context = np.zeros(index.shape)
    for r in rows:
        slots = [s for s, _, _ in plain_tokens(r.text or "")]
        for i, s in enumerate(slots):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(slots):
                    context[s] += index[slots[j]]
    assert np.allclose(contexts(every, index), context, atol=1e-3)
    got = {r.doc_id: r.score for r in score(every, (vectors, net)).collect()}
    for r in rows[::5] + rows[-13:]:
        x = [(a - m) / s for a, m, s in zip(plain_features(r.text or "", vectors), net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(len(net.b1))]
        z = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-4)


def test_the_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(4000) < p).astype(float)
    net = train(x[:3000], y[:3000])
    q = net.probabilities(x[3000:])
    assert np.mean((q - p[3000:]) ** 2) < 0.02 and isinstance(net, Network)


def test_one_class_and_none():
    assert train(np.zeros((3, 2)), np.ones(3)).probabilities(np.zeros((1, 2)))[0] > 0.99
    assert train(np.zeros((0, 2)), np.zeros(0)).probabilities(np.zeros((1, 2)))[0] == pytest.approx(0.5)


def test_held_out(spark, corpus, tmp_path):
    for name, df in zip(("documents", "labels"), corpus, strict=True):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = {r.doc_id: r for r in op8_quality(spark, str(tmp_path)).collect()}
    truth = {r.doc_id: r.quality for r in corpus[1].collect() if r.quality is not None}
    tested = [i for i in truth if i in rows and rows[i].held_out]
    assert len(tested) > 80 and sum(rows[i].predicted == truth[i] for i in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values()) and len(rows) == corpus[0].count()


def test_empty(corpus):
    docs, labels = corpus
    assert score(docs.limit(0), fit(docs, labels.limit(0))).count() == 0
