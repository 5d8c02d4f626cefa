"""Removal of repeated passages: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Run-length indexes decide that, by bytes (see run_index). So that no index grows with the corpus, equal strings are brought
together first: of the 33 18-byte strings in a 50-byte string, the one with the smallest hash is its anchor. Equal strings have equal anchors
at equal places. The strings in a row with one anchor form a window (82 bytes at most). Hashes only choose where windows meet: a
collision costs work and changes nothing.

1. Texts are written in bundles. Bundles ask in how many texts their anchors are; only windows of shared anchors go on.
2. A bundle sends its distinct windows, each once with its least id, to a part of the key space by their anchor. An anchor in more than
   ``hot_texts`` texts is no key: its windows go as single strings, each to a part of its own hash, so that no part gathers them.
3. A part indexes its distinct windows, in the order of their least ids, as a run-compressed Burrows-Wheeler transform with sampled run
   ends, and streams them through it: for each string, the sample tells the first window that has it, whose id is the least.
4. Bundles get the least ids of their windows' strings, mark the strings whose least id is smaller than their own, and remove them.

Parts and bundles have a few megabytes however large the input is. Nothing is capped: a window goes once for each bundle, however many
rows hold it. Texts are cut into overlapping pieces while windows are sought, so a long text costs no more memory than its bytes.

Defined results: a null text counts as empty; a null id counts as larger than all others, and as equal to other null ids;
rows of one id don't remove each other's bytes; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundles import MESSAGE, Texts, bundled, column, kind_of, messages, planes, runs
from .common import chunks, discard, materialise, shuffle_partitions, table
from .run_index import LENGTH, RunIndex

GRAM, CHUNK, PART = 18, 1 << 16, 2 << 20
SPAN = LENGTH - GRAM + 1
POSITION_BITS, KEY_BITS = np.uint64(20), 44  # an anchor's key is the rest of its hash
LOW = np.uint64((1 << 20) - 1)
HOT_TEXTS = 8192
TIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
ANCHORS, PLACES, WINDOWS, OWNERS = range(4)  # kinds of messages


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy() if len(data) > 7 else np.zeros(0, np.uint64)


def hashed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for k, x in enumerate(parts):
        out += x
        out *= TIMES[k % 3]
        out ^= out >> np.uint64(32 - k % 3)
    return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, anchor's hash) of the windows of texts that lie end to end, a megabyte at most."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    eight, m = words(data), n - GRAM + 1
    grams = hashed(eight[:m], eight[8 : 8 + m], eight[GRAM - 8 : GRAM - 8 + m])
    least, size = (grams & ~LOW) | np.arange(m, dtype=np.uint64), 1
    while 2 * size <= SPAN:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < SPAN:
        least = np.minimum(least[: size - SPAN], least[SPAN - size :])
    anchor = (least & LOW).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(offsets[1:][text] - np.arange(len(anchor)) >= LENGTH)
    anchor, text = anchor[start], text[start]
    cut, count = runs(anchor)
    return text[cut], start[cut], count + LENGTH - 1, hashed(grams[anchor[cut]])  # anew: least hashes aren't spread evenly


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place of the first byte, bytes, offsets) of runs of texts; a long text comes in pieces that overlap by 49 bytes."""
    for a, b in chunks(offsets, CHUNK):
        if b - a > 1 or offsets[b] - offsets[a] <= CHUNK:
            yield a, int(offsets[a]), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        else:
            for x in range(int(offsets[a]), int(offsets[b]), CHUNK):
                y = min(x + CHUNK + LENGTH - 1, int(offsets[b]))
                yield a, x, data[x:y], np.array([0, y - x])


def all_windows(t: Texts) -> tuple[np.ndarray, ...]:
    """(text, start in the bundle's data, length, anchor's key) of a bundle's windows."""
    found = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))]
    for first, at, data, offsets in pieces(t.data, t.offsets):
        text, start, length, anchor = windows(data, offsets)
        found.append((text + first, start + at, length, anchor >> POSITION_BITS))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def distinct_keys(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and in how many texts each is."""
    both = np.sort(key << POSITION_BITS | text.astype(np.uint64))
    both = both[runs(both)[0]] >> POSITION_BITS
    cut, count = runs(both)
    return both[cut], count


def by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of keys in order."""
    shard = keys >> np.uint64(KEY_BITS - bits)
    cut, count = runs(shard)
    yield from zip(shard[cut].tolist(), cut.tolist(), (cut + count).tolist(), strict=True)


def ask_anchors(t: Texts, bits: int) -> list[dict]:
    """A bundle's anchors: the low half of their keys, and in how many of its texts each is."""
    text, _, _, key = all_windows(t)
    keys, n = distinct_keys(text, key)
    low, n = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(n, 65535).astype("<u2")
    return [{"bundle": t.bundle, "kind": ANCHORS, "shard": s, "a": low[x:y].tobytes(), "b": planes(n[x:y])} for s, x, y in by_shard(keys, bits)]


def count_anchors(asked: DataFrame, hot_texts: int) -> DataFrame:
    """For each of a bundle's anchors: 0 if one text has it, 1 if several have, 2 if more than ``hot_texts``."""

    def run(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["a"]]
        n = column(rows, "b", "<u2").astype(np.int64)
        both = np.sort(np.concatenate(own).astype(np.uint64) << np.uint64(32) | np.arange(len(n), dtype=np.uint64))
        at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut, count = runs(both >> np.uint64(32))
        total = np.add.reduceat(n[at], cut)
        state = np.empty(len(n), np.uint8)
        state[at] = np.repeat((total > 1).astype(np.uint8) + (total > hot_texts), count)
        ends, shard = np.cumsum([len(x) for x in own]), rows["shard"][0].as_py()
        return messages([{"bundle": b, "kind": ANCHORS, "shard": shard, "a": state[y - len(x) : y].tobytes()} for b, x, y in zip(rows["bundle"].to_pylist(), own, ends, strict=True)])

    return asked.groupBy("shard").applyInArrow(run, MESSAGE)


def cut_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The stretches of some bytes, as an array."""
    ends = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(0, len(start), 1 << 14):
        x, y = ends[k], ends[min(k + (1 << 14), len(start))]
        out[x:y] = data[np.arange(y - x) + np.repeat(start[k : k + (1 << 14)] - ends[k : k + (1 << 14)][: len(start) - k] + x, length[k : k + (1 << 14)])]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def told_apart(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each stretch, where each number is first): stretches of equal bytes have equal numbers."""
    code = cut_out(data, start, length).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which stretch, start) of each 50-byte string of some stretches."""
    count = length - LENGTH + 1
    which = np.repeat(np.arange(len(start)), count)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def open_windows(texts: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """PLACES: where a bundle's shared windows are, and their numbers. WINDOWS: for each part, the distinct ones with their least ids."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return messages([])
        t = Texts.of(rows)
        text, start, length, key = all_windows(t)
        keys = distinct_keys(text, key)[0]
        state = np.frombuffer(b"".join(kind_of(answers, ANCHORS)["a"].to_pylist()), np.uint8) if len(keys) else np.zeros(0, np.uint8)
        keys, state = keys[state > 0], state[state > 0]
        if not len(keys):
            return messages([])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        keep = np.flatnonzero(keys[at] == key)
        text, start, length, key, hot = text[keep], start[keep], length[keep], key[keep], state[at[keep]] == 2
        code, first = told_apart(t.data, start, length)
        cold, warm = np.flatnonzero(~hot[first]), np.flatnonzero(hot[first])
        # strings of the distinct windows of hot anchors
        of, at = spread(start[first[warm]], length[first[warm]])
        string, example = told_apart(t.data, at, np.full(len(at), LENGTH))
        at, of = at[example], of[example]
        eight = np.ndarray((max(1, len(t.data) - 7),), "<u8", t.data if len(t.data) > 7 else np.zeros(8, np.uint8), strides=(1,))
        own = hashed(*(eight[at + k] for k in (0, 8, 16, 24, 32, 40, 42))) >> POSITION_BITS
        # what is sent: the other windows, then the strings; in the order of parts
        route = np.concatenate((key[first[cold]], own))
        begin = np.concatenate((start[first[cold]], at))
        size = np.concatenate((length[first[cold]], np.full(len(at), LENGTH)))
        least = np.concatenate((text[first[cold]], text[first[warm]][of]))
        order = np.argsort(route >> np.uint64(KEY_BITS - bits), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        route, begin, size, least = route[order], begin[order], size[order], least[order]
        # where they are
        at_cold = np.full(len(first), -1)
        at_cold[cold] = np.arange(len(cold))
        plain, strings = np.flatnonzero(~hot), np.flatnonzero(hot)
        base = np.zeros(len(first), np.int64)
        count = length[first[warm]] - LENGTH + 1
        base[warm] = np.cumsum(count) - count
        which, where = spread(start[strings], length[strings])
        string_of = string[base[code[strings]][which] + where - start[strings][which]] + len(cold)
        places = [
            np.concatenate((text[plain], text[strings][which])).astype("<u4"),
            np.concatenate((start[plain], where)),
            np.concatenate((length[plain], np.full(len(which), LENGTH))).astype(np.uint8),
            number[np.concatenate((at_cold[code[plain]], string_of))].astype("<u4"),
        ]
        out = [{"bundle": t.bundle, "kind": PLACES, "shard": 0} | dict(zip("abcd", map(planes, places), strict=True))]
        ids, null = t.ids.fill_null(0).to_numpy()[least], t.ids.is_null().to_numpy(zero_copy_only=False)[least]
        for s, x, y in by_shard(route, bits):
            data = cut_out(t.data, begin[x:y], size[x:y]).buffers()[2].to_pybytes()
            out.append({"bundle": t.bundle, "kind": WINDOWS, "shard": s, "a": data, "b": size[x:y].astype(np.uint8).tobytes(), "c": planes(ids[x:y]), "d": null[x:y].tobytes()})
        return messages(out)

    return texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(run, MESSAGE)


def settle(opened: DataFrame) -> DataFrame:
    """OWNERS, for each of a bundle's windows in a part: how many stretches of strings there are with one least id, where each ends, and the id."""

    def run(rows: pa.Table) -> pa.Table:
        size = np.frombuffer(b"".join(rows["b"].to_pylist()), np.uint8).astype(np.int64)
        data = np.frombuffer(b"".join(rows["a"].to_pylist()), np.uint8)
        ids, null = column(rows, "c", "<i8"), np.frombuffer(b"".join(rows["d"].to_pylist()), bool)
        known, rank = np.unique(ids[~null], return_inverse=True)
        owner = np.full(len(ids), len(known))
        owner[~null] = rank
        code, first = told_apart(data, np.cumsum(size) - size, size)
        least = np.full(len(first), len(known))
        np.minimum.at(least, code, owner)
        # the index has each window once, in the order of the least ids
        order = np.argsort(least, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        text = cut_out(data, (np.cumsum(size) - size)[first[order]], size[first[order]])
        index = RunIndex(np.frombuffer(text.buffers()[2], np.uint8), np.frombuffer(text.buffers()[1], np.int64))
        window = np.repeat(np.arange(len(order)), index.rows)
        found = least[order][window[index.stream()]]
        cut, count = runs(window * (len(known) + 1) + found)
        window, end = window[cut], cut + count - index.base[window[cut]]
        stretches = np.bincount(window, minlength=len(order))
        begin = np.cumsum(stretches) - stretches
        # by the windows as they were sent
        sent = number[code]
        n = stretches[sent]
        at = np.repeat(begin[sent] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        ids, null = np.append(known, 0)[found[cut]][at], (found[cut] == len(known))[at]
        end, n, shard = end[at].astype(np.uint8), n.astype(np.uint8), rows["shard"][0].as_py()
        windows = np.cumsum([0, *(len(x) for x in rows["b"].to_pylist())])
        parts = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[windows]
        return messages([
            {"bundle": b, "kind": OWNERS, "shard": shard, "a": n[w:x].tobytes(), "b": end[y:z].tobytes(), "c": planes(ids[y:z].astype("<i8")), "d": null[y:z].tobytes()}
            for b, w, x, y, z in zip(rows["bundle"].to_pylist(), windows, windows[1:], parts, parts[1:], strict=False)
        ])

    return opened.groupBy("shard").applyInArrow(run, MESSAGE)


def marked(t: Texts, answers: pa.Table) -> np.ndarray:
    """Which bytes of a bundle go."""
    gone = np.zeros(len(t.data), bool)
    places, owners = kind_of(answers, PLACES), kind_of(answers, OWNERS)
    if not places.num_rows:
        return gone
    text, start, number = (column(places, c, k) for c, k in zip("abd", ("<u4", "<i8", "<u4"), strict=True))
    n, end = (np.frombuffer(b"".join(owners[c].to_pylist()), np.uint8).astype(np.int64) for c in "ab")
    ids, null = column(owners, "c", "<i8"), np.frombuffer(b"".join(owners["d"].to_pylist()), bool)
    begin = np.concatenate(([0], end[:-1]))
    first = np.cumsum(n) - n
    begin[first] = 0
    count = n[number]
    which = np.repeat(np.arange(len(number)), count)
    at = np.arange(len(which)) + np.repeat(first[number] - np.cumsum(count) + count, count)
    own, own_null = t.ids.fill_null(0).to_numpy()[text], t.ids.is_null().to_numpy(zero_copy_only=False)[text]
    hit = ~null[at] & (own_null[which] | (ids[at] < own[which]))
    which, at = which[hit], at[hit]
    change = np.zeros(len(t.data) + 1, np.int32)
    np.add.at(change, start[which] + begin[at], 1)
    np.add.at(change, start[which] + end[at] + LENGTH - 1, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def removed(texts: DataFrame, answers: DataFrame, with_text: bool) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, and the SHA-256 of the rest, or the rest itself."""
    kept_type = pa.binary() if with_text else pa.string()
    schema = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept", kept_type)])

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        t = Texts.of(rows)
        gone, offsets = marked(t, answers), t.offsets
        total = np.concatenate(([0], np.cumsum(gone)))[offsets]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = gone[heads]
        spans = np.concatenate(([0], np.cumsum(begins)))[offsets]
        n, kept = np.diff(total), []
        for x, y, m in zip(offsets.tolist(), offsets[1:].tolist(), n.tolist(), strict=False):
            rest = t.data[x:y] if not m else t.data[x:y][~gone[x:y]]
            kept.append(rest.tobytes() if with_text else hashlib.sha256(rest).hexdigest())
        return pa.Table.from_arrays([t.ids, *map(pa.array, (np.diff(offsets), n, np.diff(spans))), pa.array(kept, kept_type)], schema=schema)

    kept = "binary" if with_text else "string"
    return texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept {kept}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = False, hot_texts: int = HOT_TEXTS, part: int = PART) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256 or kept_text) for each row; ``part``: bytes of text for each part of the key space."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    bits = min(30, max(1, (max(shuffle_partitions(spark), size // part) - 1).bit_length()))
    texts, asked = bundled(rows, "id", "text", partial(ask_anchors, bits=bits), tag="repeats-texts", by_id=True)
    answers = materialise(count_anchors(asked, hot_texts), "repeats-shared")
    discard(asked, part=f"kind={ANCHORS}")
    opened = materialise(open_windows(texts, answers, bits), "repeats-windows", partition_by="kind", compression="zstd")
    discard(answers)
    owners = materialise(settle(opened.filter(F.col("kind") == WINDOWS)), "repeats-owners")
    discard(opened, part=f"kind={WINDOWS}")
    out = removed(texts, opened.filter(F.col("kind") == PLACES).unionByName(owners), with_text)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_text" if with_text else "kept_sha256"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
k AS (SELECT doc_id, h, n_bytes, unnest(range(0, n_bytes, 256)) AS k FROM d),
e AS (SELECT doc_id, n_bytes, k, substr(h, 2 * k + 1, 612) AS h FROM k),
b AS (SELECT doc_id, n_bytes, k, h, unnest(range(least(256, n_bytes - k))) AS i FROM e),
s AS (SELECT doc_id, k + i AS p, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN k + i + 50 <= n_bytes THEN substr(h, 2 * i + 1, 100) END AS x FROM b),
m AS (SELECT doc_id, p, byte, x IS NOT NULL AND min(doc_id) OVER (PARTITION BY x) < doc_id AS hit FROM s),
c AS (SELECT doc_id, p, byte, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
