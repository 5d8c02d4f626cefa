"""Language-model scoring of texts by context-tree weighting (see context_tree).

Texts are written in bundles. A bundle's task, with A-Z in lower case, finds the distinct keys (the ``depth`` bytes before and a symbol) of
its texts and their training counts, and sends them to shards by the two bytes before the symbol; the pairs that are over a 256th of the
corpus are dealt by the three bytes before. A shard holds whole subtrees: it adds up the counts of all bundles, weighs its trees from
the deepest contexts up, and hands sums for depth one (for those pairs, depth two) and so for the root to the driver: 512 contexts of 256
nodes at most. With the top of the tree known, the shard answers each bundle's keys with their log probabilities, in the order in which they
came, and the bundle adds them up by text. So every context of the corpus counts, the model is never in one place, and neither it
nor the texts are broadcast. Shards are as many as the input asks for, so a task's share doesn't grow with it.

The word counts for the base score go the same way; words are told apart by their bytes.

Defined results: a null text counts as empty, which has only its end; without training rows the model is uniform, the base 0;
rows with a null id train; repeated rows count and are scored each; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bundles import MESSAGE, Texts, bundled, column, kind_of, messages, planes, runs
from .common import chunks, discard, materialise, shuffle_partitions, table, utf8
from .context_tree import DECISIONS, Level, above, keys_of, level, mixed, summed, tree
from .langid import held_out

DEPTH, BUNDLE, SHARD, CHUNK = 5, 16 << 20, 8 << 20, 1 << 20
TOP, HOT_SHARE = 2, 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
KEYS, WORDS, TOTALS = range(3)  # kinds of messages


def text_bits(depth: int) -> int:
    """The bits that a key of ``depth`` leaves free."""
    return 64 - (8 * depth + 9)


def some(t: Texts, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, keys, the text of each key) for runs of texts."""
    for a, b in chunks(t.offsets, CHUNK):
        for x in range(a, b, 1 << text_bits(depth)):
            y = min(b, x + (1 << text_bits(depth)))
            offsets = t.offsets[x : y + 1] - t.offsets[x]
            yield x, y, keys_of(LOWER[t.data[t.offsets[x] : t.offsets[y]]], offsets, depth), np.repeat(np.arange(y - x, dtype=np.uint64), np.diff(offsets) + 1)


def bundle_keys(t: Texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bundle in order, and their training counts."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for x, _, key, text in some(t, depth):
        both = np.sort(key << np.uint64(1) | t.flags[x:][text.astype(np.int64)])
        cut, count = runs(both)
        found.append((both[cut] >> np.uint64(1), np.where(both[cut] & np.uint64(1), count, 0)))
    return summed(*map(np.concatenate, zip(*found, strict=True)))


def bundle_words(t: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, which of them each word is, where each text's words end)."""
    white = WHITE[t.data]
    turn = np.ones(len(t.data), bool)
    turn[1:] = white[1:] != white[:-1]
    turn[t.offsets[:-1][t.offsets[:-1] < len(t.data)]] = True
    begin = np.flatnonzero(turn)
    size = np.diff(np.append(begin, len(t.data)))
    keep = ~white[begin]
    begin, size = begin[keep], size[keep]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(LOWER[t.data[~white]])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(begin, t.offsets)


def word_order(words: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards of the words, the words by shard)."""
    shard = np.array([xxh64_intdigest(w.as_buffer()) % shards for w in words], np.int64)
    return shard, np.argsort(shard, kind="stable")


def key_order(keys: np.ndarray, depth: int, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards of the keys, the keys by shard)."""
    pair = keys >> np.uint64(8 * (depth - TOP) + 9)
    route = np.where(hot[pair.astype(np.int64)], keys >> np.uint64(8 * (depth - TOP - 1) + 9) | np.uint64(1 << 40), pair)
    shard = (((route * GOLDEN) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    return shard, np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


def pair_counts(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """(how often each two bytes stand together, training texts, bytes): 65,538 numbers for the driver at most. texts: (text binary, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << 16) + 2, np.int64)
        for batch in batches:
            low = LOWER[utf8(batch.column(0))[0]]
            n[1 << 16 :] += np.array([pc.sum(batch.column(1)).as_py() or 0, len(low)])
            for k in range(0, len(low), CHUNK):
                own = low[k : k + CHUNK + 1].astype(np.int64)
                n[: 1 << 16] += np.bincount(own[1:] << 8 | own[:-1], minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])

    n = np.zeros((1 << 16) + 2, np.int64)
    for k, x in texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        n[k] = x
    return n[: 1 << 16], int(n[-2]), int(n[-1])


def ask(t: Texts, depth: int, hot: np.ndarray, shards: int) -> list[dict]:
    """KEYS and WORDS for each shard, with their training counts."""
    keys, n = bundle_keys(t, depth)
    shard, order = key_order(keys, depth, hot, shards)
    keys, n = keys[order], n[order].astype("<u4")
    cut, count = runs(shard[order])
    out = [{"bundle": t.bundle, "kind": KEYS, "shard": s, "a": planes(keys[x : x + k]), "b": planes(n[x : x + k])} for s, x, k in zip(shard[order][cut].tolist(), cut, count, strict=True)]
    words, code, ends = bundle_words(t)
    n = np.bincount(code[np.repeat(t.flags, np.diff(ends))], minlength=len(words))
    shard, order = word_order(words, shards)
    words, n = words.take(pa.array(order)), n[order].astype("<u4")
    cut, count = runs(shard[order])
    for s, x, k in zip(shard[order][cut].tolist(), cut.tolist(), count.tolist(), strict=True):
        own = words.slice(x, k).to_pylist()
        out.append({"bundle": t.bundle, "kind": WORDS, "shard": s, "a": b"".join(own), "b": planes(np.fromiter(map(len, own), "<u4", k)), "c": planes(n[x : x + k])})
    return out


def merged(asked: DataFrame) -> DataFrame:
    """The training keys of each shard and their counts."""

    def run(rows: pa.Table) -> pa.Table:
        keys, n = summed(column(rows, "a", "<u8"), column(rows, "b", "<u4").astype(np.int64))
        return messages([{"bundle": 0, "kind": KEYS, "shard": rows["shard"][0].as_py(), "a": planes(keys[n > 0]), "b": planes(n[n > 0].astype("<i8"))}])

    return asked.groupBy("shard").applyInArrow(run, MESSAGE)


def top_sums(model: DataFrame, depth: int, hot: np.ndarray) -> list:
    """For the nodes of depth one, and of depth two after hot pairs: counts, and the sum of the children's ln P_w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(k, 1) for k in range(batch.num_rows)):
                keys, n = column(pa.table(rows), "a", "<u8"), column(pa.table(rows), "b", "<i8")
                for j in range(DECISIONS):
                    own = tree(keys, n, j, depth, TOP)[TOP]
                    split = hot[(own.nodes >> np.uint64(9)).astype(np.int64)]
                    part = own.of(split)
                    for d, found in ((1, above(own.of(~split))), (2, (part.nodes, part.zeros, part.ones, part.below))):
                        m = len(found[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, d)), pa.array(np.full(m, j)), pa.array(found[0].astype(np.int64)), *map(pa.array, found[1:])], ["depth", "j", "node", "zeros", "ones", "below"])

    rows = model.select("a", "b").mapInArrow(run, "depth long, j long, node long, zeros double, ones double, below double")
    return rows.groupBy("depth", "j", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()


def top_levels(rows: list) -> list[dict[int, Level]]:
    """Depths zero and one of each decision's tree, and what is hot of depth two, from sums over the shards."""
    x = np.array([tuple(r) for r in rows], float).reshape(len(rows), 6)
    out = []
    for j in range(DECISIONS):
        def part(d: int, more: tuple[np.ndarray, ...] | None = None) -> Level:
            own = x[(x[:, 0] == d) & (x[:, 1] == j)]  # noqa: B023
            found = (own[:, 2].astype(np.uint64), own[:, 3], own[:, 4], own[:, 5])
            found = found if more is None else tuple(map(np.concatenate, zip(found, more, strict=True)))
            nodes, at = np.unique(found[0], return_inverse=True)
            return level(nodes, *(np.bincount(at, weights=v, minlength=len(nodes)) for v in found[1:]))

        two = part(2)
        one = part(1, above(two))
        out.append({0: level(*above(one)), 1: one, 2: two})
    return out


def answer_keys(asked: DataFrame, model: DataFrame, top: list[dict[int, Level]], depth: int, hot: np.ndarray) -> DataFrame:
    """The ln P of each bundle's keys of a shard, in their order."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return messages([])
        own = column(asked, "a", "<u8")
        sizes = np.array([len(x) // 8 for x in (a.as_buffer() for a in asked["a"])])
        keys, n = column(known, "a", "<u8"), column(known, "b", "<i8")

        def levels(j: int) -> dict[int, Level]:
            found = tree(keys, n, j, depth, TOP)
            cold, split = found[TOP].of(~hot[(found[TOP].nodes >> np.uint64(9)).astype(np.int64)]), top[j][TOP]
            both = [np.concatenate(v) for v in zip(*((v.nodes, v.zeros, v.ones, v.ln_pw, v.stop) for v in (cold, split)), strict=True)]
            order = np.argsort(both[0])
            nodes, zeros, ones, ln_pw, stop = (v[order] for v in both)
            return found | {0: top[j][0], 1: top[j][1], TOP: Level(nodes, zeros, ones, None, ln_pw, stop)}

        distinct = np.unique(own)
        value = mixed(distinct, depth, levels)[np.searchsorted(distinct, own)]
        ends, shard = np.cumsum(sizes), asked["shard"][0].as_py()
        return messages([{"bundle": b, "kind": KEYS, "shard": shard, "a": planes(value[y - k : y])} for b, k, y in zip(asked["bundle"].to_pylist(), sizes, ends, strict=True)])

    return asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(run, MESSAGE)


def answer_words(asked: DataFrame) -> DataFrame:
    """The training counts of each bundle's words of a shard, in their order; and TOTALS, whose ``bundle`` is the shard's number of training
    words and whose ``shard`` that of distinct ones."""

    def run(rows: pa.Table) -> pa.Table:
        size, n = column(rows, "b", "<u4").astype(np.int64), column(rows, "c", "<u4").astype(np.int64)
        data = pa.py_buffer(b"".join(rows["a"].to_pylist()))
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), data])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, code, n)
        sizes = [len(x.as_buffer()) // 4 for x in rows["b"]]
        shard = rows["shard"][0].as_py()
        out = [{"bundle": b, "kind": WORDS, "shard": shard, "a": planes(total[code[y - k : y]])} for b, k, y in zip(rows["bundle"].to_pylist(), sizes, np.cumsum(sizes), strict=True)]
        return messages([*out, {"bundle": int(total.sum()), "kind": TOTALS, "shard": int((total > 0).sum())}])

    return asked.groupBy("shard").applyInArrow(run, MESSAGE)


def scored(texts: DataFrame, answers: DataFrame, kind_of_id: str, depth: int, hot: np.ndarray, shards: int, total: int, distinct: int, ends: int) -> DataFrame:
    floor = total + 0.5 * (distinct + 1)
    names = ["id", "train", "n_tokens", "n_known", "base_score", "score"]
    kinds = f"id {kind_of_id}, train boolean, n_tokens long, n_known long, base_score double, score double"

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], rows.schema.field("id").type), pa.array([], pa.bool_()), *(pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)
        t, bits = Texts.of(rows), np.uint64(text_bits(depth))
        keys, _ = bundle_keys(t, depth)
        value = np.zeros(len(keys))
        value[key_order(keys, depth, hot, shards)[1]] = column(kind_of(answers, KEYS), "a", "<f8")
        score = np.zeros(len(t))
        for x, y, key, text in some(t, depth):
            both = np.sort(key << bits | text)
            cut, count = runs(both >> bits)
            ln = np.repeat(value[np.searchsorted(keys, both[cut] >> bits)], count)
            score[x:y] = np.bincount((both & np.uint64((1 << int(bits)) - 1)).astype(np.int64), weights=ln, minlength=y - x)
        words, code, stops = bundle_words(t)
        n = np.zeros(len(words), np.int64)
        n[word_order(words, shards)[1]] = column(kind_of(answers, WORDS), "a", "<i8")
        own = np.repeat(np.arange(len(t)), np.diff(stops))
        known = np.bincount(own, weights=n[code] > 0, minlength=len(t)).astype(np.int64) + int(ends > 0)
        base = np.bincount(own, weights=np.log10((n + 0.5) / floor)[code], minlength=len(t)) + np.log10((ends + 0.5) / floor)
        return pa.Table.from_arrays([t.ids, *map(pa.array, (t.flags, np.diff(stops) + 1, known, base, score / np.log(10)))], names)

    return texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(run, kinds)


def lm_score(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH) -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score); ``train`` marks training rows, else all are; ``depth``: 3 to 6
    bytes of context."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6")
    spark = docs.sparkSession
    mark = F.lit(True) if train is None else F.coalesce(train, F.lit(True))
    pairs, ends, size = pair_counts(docs.select(F.col(text_col).cast("string").cast("binary"), mark))
    hot = pairs * HOT_SHARE > max(1, pairs.sum())
    shards = max(shuffle_partitions(spark), 1 + size // SHARD)
    texts, asked = bundled(docs, id_col, text_col, partial(ask, depth=depth, hot=hot, shards=shards), mark, tag="lm-texts", most=BUNDLE)
    keys, words = (asked.filter(F.col("kind") == k) for k in (KEYS, WORDS))
    model = materialise(merged(keys), "lm-model")
    by_key = materialise(answer_keys(keys, model, top_levels(top_sums(model, depth, hot)), depth, hot), "lm-keys")
    by_word = materialise(answer_words(words), "lm-words")
    discard(model)
    for kind in (KEYS, WORDS):
        discard(asked, part=f"kind={kind}")
    count = F.coalesce(F.sum(F.col("bundle")), F.lit(0)), F.coalesce(F.sum(F.col("shard").cast("long")), F.lit(0))
    total, distinct = by_word.filter(F.col("kind") == TOTALS).agg(*count).first()
    answers = by_key.unionByName(by_word.filter(F.col("kind") == WORDS))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = scored(texts, answers, kind, depth, hot, shards, total + ends, distinct + (ends > 0), ends)
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(total + ends).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 5, 1))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
