"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public vocabulary file (a parameter) span a lattice over the UTF-8 bytes of a text; a piece's weight
is (1 + its rank) ** -alpha. Forward filtering sums the weights of all ways to reach each byte; backward
sampling draws, from the end, each piece in proportion to the weight of the ways through it: a segmentation is drawn
with exactly its share of the total weight. Random numbers are made from (seed, row key, byte position), so a row's
segmentation doesn't depend on partitions, batches or other rows.

No piece of the file spans a line break or continues after a space, so the lattice falls apart into words; distinct words
of a batch are filtered once, all together in numpy, and their occurrences are drawn together, a piece each step. Equal words are
those of equal bytes. Where the least weight of a word isn't a normal double, sums are of logarithms. A word over ``LONG`` bytes (a line
without spaces) is filtered in windows: only the sums at the windows' ends are kept, and each window is filtered again
when the draw, from the end, reaches it; so memory holds its bytes, its pieces and one window's lattice.

A space is the file's word mark; one is added before a text, and the decoder takes it off. A byte that is no piece by
itself has a byte piece, of weight e**-11.5; so have those of a literal word mark, which no other piece covers.
Decoding joins the bytes of the pieces: it returns each text as it was.

Defined results: a null text has null pieces and decodes to null; an empty text has no pieces and decodes to an empty
text; a null key counts as a key of its own; rows that repeat a key and text get equal pieces (also copies that mixing makes); an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BYTE_LP = -11.5
CHUNK, LONG, WINDOW = 1 << 21, 1 << 11, 1 << 15  # bytes


@dataclass
class Vocabulary:
    """Pieces as bytes, end to end, and their trie: transitions (state, byte) in hash tables, each for what collides in the one before."""

    lp: np.ndarray
    byte_ids: np.ndarray
    flat: np.ndarray
    offsets: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    piece: np.ndarray  # of a state, or -1

    @property
    def linear(self) -> int:
        """The bytes up to which a word's least weight is a normal double."""
        return int(700 / max(1e-9, -float(self.lp.min())))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; 0 is dead."""
        key = ((state.astype(np.int64) << 8) | byte).ravel()
        out, live = np.zeros(len(key), np.int32), None
        for keys, values in self.tables:
            own = key if live is None else key[live]
            at = slot(own, len(keys))
            held = keys[at]
            hit = held == own
            if live is None:
                out = np.where(hit, values[at], np.int32(0))
                live = np.flatnonzero(~hit & (held >= 0))
            else:
                out[live[hit]] = values[at[hit]]
                live = live[~hit & (held >= 0)]
            if not len(live):
                break
        return out.reshape(state.shape)


def slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.view(np.uint64) * GOLDEN) >> np.uint64(65 - size.bit_length())).view(np.int64)


def vocabulary(pieces: list[bytes | None], byte_ids: list[int], alpha: float) -> Vocabulary:
    """pieces: None for those that text never becomes (control and byte pieces)."""
    lp = -alpha * np.log1p(np.arange(len(pieces), dtype=float))
    lp[byte_ids] = BYTE_LP
    trie: dict[int, int] = {}
    of = [-1, -1]  # dead, root
    for i, p in enumerate(pieces):
        state = 1
        for c in p or b"":
            state = trie.setdefault(state << 8 | c, len(of))
            if state == len(of):
                of.append(-1)
        if p:
            of[state] = i
    keys, values = np.array([*trie], np.int64), np.array([*trie.values()], np.int32)
    tables, size = [], 1 << 18
    while len(keys):
        at = slot(keys, size)
        _, first = np.unique(at, return_index=True)
        table_keys, table_values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        table_keys[at[first]], table_values[at[first]] = keys[first], values[first]
        tables.append((table_keys, table_values))
        rest = np.setdiff1d(np.arange(len(keys)), first)
        keys, values, size = keys[rest], values[rest], max(1 << 10, size >> 1)
    full = [p or b"" for p in pieces]
    for value, i in enumerate(byte_ids):
        full[i] = bytes([value])
    return Vocabulary(lp, np.array(byte_ids, np.int32), np.frombuffer(b"".join(full), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in full]))), tables, np.array(of, np.int32))


@lru_cache(4)
def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
    """Read on the driver; tasks get the pieces, whose number the file bounds."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [0] * 256
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        special = m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        pieces.append(None if special else p.replace("▁", " ").encode())
    if bad := [p for p in pieces if p and (b"\n" in p or re.search(rb"[^ ] ", p))]:
        raise ValueError(f"pieces span words: {bad[:3]}")
    return vocabulary(pieces, byte_ids, alpha)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(words: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """For words of one size as columns of bytes: by length L, the piece from each start (-1: none)."""
    n, state, out = len(words), np.ones(words.shape, np.int32), []
    for size in range(1, n + 1):
        state = v.step(state[: n - size + 1], words[size - 1 :])
        piece = v.piece[state]
        if size == 1:
            piece = np.where(piece < 0, v.byte_ids[words], piece)
        out.append(piece)
        if not state.any():
            break
    return out


def forward(words: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lattices of words of one size (as columns of bytes), word by word and end by end: for each node after
    the first, how many edges end in it; for each edge, the share of the weight of edges up to it, its piece and length."""
    n, m = words.shape
    by_length = edges(words, v)
    most = len(by_length)
    share, piece = np.zeros((n, most, m)), np.zeros((n, most, m), np.int32)
    if n <= v.linear:
        total, weights = np.zeros((n + 1, m)), [np.where(p >= 0, np.exp(v.lp[p]), 0.0) for p in by_length]
        total[0] = 1.0
        for end in range(1, n + 1):
            for size in range(1, min(end, most) + 1):
                share[end - 1, size - 1] = total[end - size] * weights[size - 1][end - size]
                piece[end - 1, size - 1] = by_length[size - 1][end - size]
            np.sum(share[end - 1], 0, out=total[end])
        share /= total[1:, None]
    else:
        total = np.full((n + 1, m), -np.inf)
        total[0] = 0.0
        for end in range(1, n + 1):
            size = np.arange(1, min(end, most) + 1)
            ids = np.array([by_length[k - 1][end - k] for k in size])
            way = np.where(ids >= 0, total[end - size] + v.lp[ids], -np.inf)
            top = way.max(0)
            total[end] = top + np.log(np.exp(way - top).sum(0))
            share[end - 1, : len(size)], piece[end - 1, : len(size)] = np.exp(way - total[end]), ids
    held = np.ascontiguousarray(share.transpose(2, 0, 1)).reshape(m * n, most)
    real = held > 0
    at = np.flatnonzero(real)
    return real.sum(1), np.cumsum(held, 1).ravel()[at], np.ascontiguousarray(piece.transpose(2, 0, 1)).ravel()[at], at % most + 1


class LongWord:
    """A word filtered in windows, in logarithms."""

    def __init__(self, word: np.ndarray, v: Vocabulary):
        self.word, self.v, self.most = word, v, int(np.diff(v.offsets).max())
        self.frontiers, total = [], [0.0]  # of each window, the sums at the last places before it
        for a in range(0, len(word), WINDOW):
            self.frontiers.append(total[-self.most :])
            total = self.window(a, self.frontiers[-1])[0]

    def window(self, a: int, frontier: list[float]) -> tuple[list[float], list[int], list[int], list[int], list[float]]:
        """The sums at the places a - len(frontier) + 1 to the window's end; and for the edges that end after a, by end and length:
        where each end's begin, the pieces, their lengths, the sums of the ways through them."""
        low, b = a - len(frontier) + 1, min(a + WINDOW, len(self.word))
        by_length = edges(self.word[low : min(b + self.most, len(self.word)), None], self.v)
        found = [(np.flatnonzero(x[:, 0] >= 0), k + 1, x[:, 0]) for k, x in enumerate(by_length)]
        start, size, piece = (np.concatenate(x) for x in zip(*((s, np.full(len(s), k), x[s]) for s, k, x in found), strict=True))
        end = start + size + low
        keep = np.flatnonzero((end > a) & (end <= b))
        keep = keep[np.lexsort((size[keep], end[keep]))]
        ptr = np.searchsorted(end[keep], np.arange(a + 1, b + 2)).tolist()
        ids, sizes, lp = piece[keep].tolist(), size[keep].tolist(), self.v.lp[piece[keep]].tolist()
        total, ways = list(frontier), []
        for x, y in zip(ptr, ptr[1:], strict=False):
            here = len(total)
            own = [total[here - sizes[e]] + lp[e] for e in range(x, y)]
            top = max(own)
            total.append(top + math.log(math.fsum(math.exp(w - top) for w in own)))
            ways += own
        return total, ptr, ids, sizes, ways

    def draw(self, seed: np.uint64, place: int) -> np.ndarray:
        """The pieces of an occurrence; ``place``: where the word begins in its text."""
        found, at = [], len(self.word)
        for k in range(len(self.frontiers) - 1, -1, -1):
            a, frontier, out = k * WINDOW, self.frontiers[k], []
            if at <= a:
                continue
            total, ptr, ids, sizes, ways = self.window(a, frontier)
            random = draws(seed, np.arange(a + 1, min(a + WINDOW, len(self.word)) + 1) + place).tolist()
            while at > a:
                x, y, u = ptr[at - a - 1], ptr[at - a], random[at - a - 1]
                here, up = total[len(frontier) + at - a - 1], 0.0
                for e in range(x, y):
                    up += math.exp(ways[e] - here)
                    if u < up:
                        break
                out.append(ids[e])
                at -= sizes[e]
            found.append(np.array(out, np.int32))
        return np.concatenate(found)[::-1]


def draws(seed: np.ndarray | np.uint64, byte: np.ndarray) -> np.ndarray:
    """Random numbers of [0, 1) for places in texts."""
    return (splitmix(seed + byte.astype(np.uint64)) >> np.uint64(11)) * 2.0**-53


def split(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin: at a text's start, at and after a line break, at the first of some spaces."""
    line, space = buffer == 10, buffer == 32
    cut = line.copy()
    cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    cut[starts] = True
    return np.flatnonzero(cut)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """GOLDEN ** i and its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (GOLDEN, inverse))


def encode(texts: list[bytes], keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts end to end, and the offsets of the texts. keys: one uint64 a text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    buffer = np.frombuffer(b" " + b" ".join([t for t in texts if t]), np.uint8)
    heads = np.concatenate(([0], np.cumsum(sizes[full] + 1)))
    begin = split(buffer, heads[:-1])
    stop = np.append(begin[1:], len(buffer))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(buffer))), pa.py_buffer(buffer)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    example = np.zeros(int(code.max()) + 1, np.int64)
    example[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size, at = (stop - begin)[example], begin[example]
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], LONG, "right")]
    base, nodes = np.zeros(len(size), np.int64), 0  # the node of a word's start
    counts, share, piece, length = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    cuts = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = int(size[order[a]])
        block = max(1, 1 << 20 >> max(4, 2 * n.bit_length() - 2) )
        for k in range(a, b, block):
            own = order[k : min(k + block, b)]
            ends, *rest = forward(buffer[at[own] + np.arange(n)[:, None]], v)
            counts.append(np.concatenate((np.zeros((len(own), 1), np.int64), ends.reshape(len(own), n)), 1).ravel())
            for x, y in zip((share, piece, length), rest, strict=True):
                x.append(y)
            base[own] = nodes + np.arange(len(own)) * (n + 1)
            nodes += len(own) * (n + 1)
    last = np.cumsum(np.concatenate(counts))
    first = last - np.concatenate(counts)
    share, piece, length = map(np.concatenate, (share, piece, length))
    # backward: each step draws a piece for all words that aren't at their start
    words = np.diff(np.searchsorted(begin, heads))
    doc = np.repeat(np.arange(len(full)), words)
    start = base[code]
    state = start + stop - begin
    byte = stop - heads[doc]  # of the node, within its text
    seeds, live, drawn, number = splitmix(keys[full]), np.flatnonzero(size[code] <= LONG), [], np.zeros(len(code), np.int64)
    long = {}
    for w in np.flatnonzero(size[code] > LONG).tolist():
        if code[w] not in long:
            long[code[w]] = LongWord(buffer[begin[w] : stop[w]], v)
        drawn.append((w, long[code[w]].draw(seeds[doc[w]], int(begin[w] - heads[doc[w]]))))
        number[w] = len(drawn[-1][1])
    apart, drawn = drawn, []
    while len(live):
        node = state[live]
        u = draws(seeds[doc[live]], byte[live])
        edge, most = first[node], last[node] - 1
        go = np.arange(len(live))
        while len(go := go[(u[go] >= share[edge[go]]) & (edge[go] < most[go])]):
            edge[go] += 1
        drawn.append((live, piece[edge]))
        number[live] += 1
        state[live] -= length[edge]
        byte[live] -= length[edge]
        live = live[state[live] != start[live]]
    ends = np.cumsum(number)
    out = np.zeros(int(ends[-1]), np.int32)
    for k, (which, ids) in enumerate(drawn):
        out[ends[which] - 1 - k] = ids
    for w, ids in apart:
        out[ends[w] - len(ids) : ends[w]] = ids
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[full + 1] = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(words)))])
    return out, np.cumsum(offsets)


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The bytes of each text, less the space that encoding added."""
    sizes, parts = np.diff(v.offsets)[ids], []
    for k in range(0, len(ids), 1 << 16):
        own, n = ids[k : k + (1 << 16)], sizes[k : k + (1 << 16)]
        ends = np.cumsum(n)
        parts.append(v.flat[np.repeat(v.offsets[own] - ends + n, n) + np.arange(int(ends[-1]))])
    stop, data = np.concatenate(([0], np.cumsum(sizes))), np.concatenate([np.zeros(0, np.uint8), *parts])
    at = stop[offsets].tolist()
    return [data[a + 1 : b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    column = column.cast(pa.large_binary())
    for a, b in chunks(utf8(column)[1], CHUNK):
        yield a, b, column.slice(a, b - a).to_pylist()


def keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(id_col, pieces array<int>)."""
    rows, v = keyed(docs, id_col, text_col, seed), load(model, alpha)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in texts_of(batch.column(2)):
                ids, offsets = encode([t or b"" for t in texts], batch.column(1).to_numpy()[a:b].view(np.uint64), v)
                mask = pa.array([t is None for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=mask)], ["id", "pieces"])

    return rows.mapInArrow(run, f"id {kind}, pieces array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", *, model: str = MODEL) -> DataFrame:
    """(id_col, text)."""
    rows, v = encoded.select(F.col(id_col).alias("id"), "pieces"), load(model, 1.0)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for a in range(0, batch.num_rows, 256):
                part = lists.slice(a, 256)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = decode(part.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes))), v)
                valid = part.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([t.decode() if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(id_col, n_pieces, pieces_sha256, decoded_sha256, lossless): each text is encoded and its pieces decoded in one pass."""
    rows, v = keyed(docs, id_col, text_col, seed), load(model, alpha)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in texts_of(batch.column(2)):
                ids, offsets = encode([t or b"" for t in texts], batch.column(1).to_numpy()[a:b].view(np.uint64), v)
                back = decode(ids, offsets, v)
                null = np.array([t is None for t in texts])
                digest = [hashlib.sha256(ids[x:y].astype("<i4").tobytes()).hexdigest() for x, y in zip(offsets, offsets[1:], strict=False)]
                own = [hashlib.sha256(t).hexdigest() for t in back]
                same = np.array([(t or b"") == o for t, o in zip(texts, back, strict=True)], bool)
                columns = [pa.array(np.diff(offsets), pa.int64(), mask=null), pa.array(digest, pa.string(), mask=null), pa.array(own, pa.string(), mask=null), pa.array(same)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])

    return rows.mapInArrow(run, f"id {kind}, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean").withColumnRenamed("id", id_col)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces) of each row."""
    return encode_pieces(docs)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents"))
