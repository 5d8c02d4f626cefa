"""Quality classification over random-indexing word vectors.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of other symbols; each falls into a slot by its hash.
Random indexing: a slot has a sparse random index vector, and its word vector adds up the index vectors of the
tokens around it (two to either side) over all documents, scaled to length one, beside its own index vector. A text is
pooled to the mean and the root mean square of its word vectors and a few figures about its tokens. A two-layer numpy network
(tanh, then sigmoid) is trained on these; a temperature fitted on a part kept from training calibrates its probabilities.

The network is fitted on a bounded sample: the about ``sample`` labelled training documents with the smallest seeded hashes of
their id. Only texts and labels enter; the score of a text depends on the text alone.

Defined results: a null text counts as empty; an empty text is scored as one without tokens; labels that are null or
whose document is absent don't train; a document trains once with each label it has, by the least of its texts; with labels of one class only, that
class's share is every score; repeated rows get equal scores; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, table, utf8
from .langid import held_out
from .sampled_pieces import GOLDEN, powers

SLOT_BITS, DIMS, SEED = 13, 48, 5
SLOTS = 1 << SLOT_BITS
KIND = np.full(256, 2, np.uint8)  # symbols
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, size, is a symbol, offsets by text) of the tokens of texts laid end to end."""
    kind = KIND[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(turn)
    stop = np.append(begin[1:], len(data))
    keep = kind[begin] > 0
    begin, stop = begin[keep], stop[keep]
    power, inverse = powers(1 << max(20, len(data).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWER[data] * power[: len(data)])))
    hashed = (sums[stop] - sums[begin]) * inverse[begin]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * GOLDEN
    return (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), stop - begin, kind[begin] == 2, np.searchsorted(begin, offsets)


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, 6, replace=False)] = rng.choice([-1.0, 1.0], 6) / np.sqrt(6)
    return out


def neighbours(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total``, for each slot, the index vectors around its tokens in some texts. Equal pairs of slots are counted first."""
    slot, _, _, ends = tokens(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    pairs = np.concatenate([(slot[:-k] << SLOT_BITS | slot[k:])[doc[k:] == doc[:-k]].astype(np.uint32) for k in (1, 2) if len(slot) > k] or [np.zeros(0, np.uint32)])
    pairs = np.sort(pairs)
    cut = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(pairs)))
    a, b = (pairs[cut] >> SLOT_BITS).astype(np.int64), (pairs[cut] & (SLOTS - 1)).astype(np.int64)
    for own, other in ((a, b), (b, a)):
        order = np.argsort(own, kind="stable") if own is b else slice(None)
        own, around = own[order], index[other[order]] * n[order, None].astype(np.float32)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        if len(first):
            total[own[first]] += np.add.reduceat(around, first)


def word_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    size = np.sqrt((context * context).sum(1, keepdims=True))
    return (index + context / np.maximum(size, 1e-9)).astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    data, offsets = utf8(column)
    out = np.zeros((len(column), 2 * DIMS + 8), np.float32)
    for a, b in chunks(offsets, 1 << 18):
        slot, size, symbol, ends = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.diff(ends)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        v = vectors[slot]
        at = ends[:-1][full]
        mean = np.add.reduceat(v, at) / n[full, None]
        np.square(v, out=v)
        rows = a + full
        out[rows, :DIMS] = mean * 4
        out[rows, DIMS : 2 * DIMS] = np.sqrt(np.add.reduceat(v, at) / n[full, None])
        chars = np.add.reduceat(size, at)
        mean_size = chars / n[full]
        repeats = np.zeros(len(slot), np.float32)
        repeats[1:] = slot[1:] == slot[:-1]
        pair = np.unique(np.repeat(np.arange(len(n)), n) * SLOTS + slot)
        kinds = np.bincount(pair // SLOTS, minlength=len(n))[full]
        out[rows, 2 * DIMS :] = np.array([
            np.log1p(n[full]) / 5,
            np.sqrt((mean * mean).sum(1)) * 2,
            np.add.reduceat(symbol.astype(np.float32), at) / n[full] * 2,
            mean_size / 5,
            np.add.reduceat(repeats, at) / n[full] * 4,
            kinds / n[full],
            np.log1p(kinds) / 5,
            np.sqrt(np.maximum(np.add.reduceat(size.astype(np.float64) ** 2, at) / n[full] - mean_size**2, 0)) / 5,
        ]).T
    return out


@dataclass
class Network:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    mean: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the cross-entropy over four fifths of the rows; the rest fits the temperature."""
    rng = np.random.default_rng(SEED)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 5 or share in (0.0, 1.0):
        f = x.shape[1]
        return Network(np.zeros((f, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(f), np.ones(f))
    order = rng.permutation(len(y))
    kept, x_, y_ = order[: len(y) // 5], x[order[len(y) // 5 :]].astype(float), y[order[len(y) // 5 :]].astype(float)
    net = Network(rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0, x_.mean(0), x_.std(0) + 1e-3)
    x_ = (x_ - net.mean) / net.scale
    held = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y_))
        for k in range(0, len(order), 128):
            at, step = order[k : k + 128], step + 1
            h = np.tanh(x_[at] @ held[0] + held[1])
            g = (1 / (1 + np.exp(-np.clip(h @ held[2] + held[3], -40, 40))) - y_[at]) / len(at)
            back = np.outer(g, held[2]) * (1 - h * h)
            for p, d, i in zip(held, (x_[at].T @ back + decay * held[0], back.sum(0), h.T @ g + decay * held[2], g.sum(keepdims=True)), range(4), strict=True):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                p -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(held[0], held[1], held[2], float(held[3][0]), net.mean, net.scale)
    z, t = net.logits(x[kept].astype(float)), y[kept].astype(float)
    losses = {c: float(np.mean(np.logaddexp(0, z / c) - t * z / c)) for c in np.geomspace(0.25, 8, 41)}
    net.temperature = min(losses, key=losses.get)
    return net


def contexts(docs: DataFrame, index: np.ndarray) -> np.ndarray:
    """The sums of the index vectors around each slot's tokens, over all documents: SLOTS rows for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIMS))
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets, 1 << 19):
                neighbours(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], index, total)
        own = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x) for x in total[own].T)], ["slot", *dims])

    dims, out = [f"d{k}" for k in range(DIMS)], np.zeros((SLOTS, DIMS))
    sums = docs.select("text").mapInArrow(run, ", ".join(["slot long", *(f"{d} double" for d in dims)]))
    for slot, *x in sums.groupBy("slot").agg(*(F.sum(d) for d in dims)).collect():
        out[slot] = x
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = 12_000) -> tuple[np.ndarray, Network]:
    """(word vectors, network). The sampled labels are at most about ``sample`` rows, which bounds their broadcast, and so is
    what the driver gets."""
    rows = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col(label_col).cast("int").alias("_label")).distinct()
    n = max(1, rows.count())
    part = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)).cast("double") * n < float(sample << 40))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = part.select("doc_id").distinct()
    part = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(part), "doc_id")
    part = materialise(part.repartition(6), "quality-sample")
    index = index_vectors()
    vectors = word_vectors(contexts(text, index), index)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["doc_id", "x", "_label"])

    found = sorted(part.select("doc_id", "text", "_label").mapInArrow(pooled, "doc_id long, x binary, _label int").collect())
    discard(part)
    x = np.array([np.frombuffer(r[1], np.float32) for r in found]).reshape(len(found), 2 * DIMS + 8)
    return vectors, train(x, np.array([r[2] for r in found], float))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score)."""
    vectors, net = model
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probabilities(features(batch.column(1), vectors).astype(float)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
