"""SimHash near-deduplication by tiled exact comparison.

A text gets a fingerprint of its word shingles: a bit is 1 if it is set in over half of the shingles' hashes. Fingerprints that
differ in at most ``radius`` bits are linked; a component is what links reach.

Equal fingerprints collapse to one class first, so copies never meet as pairs. Classes are packed into tiles, each
of one population count, in the order of the population counts of their four 16-bit blocks. Two fingerprints differ in
at least as many bits as their population counts do, so only tile pairs whose counts differ by ``radius`` or less
are paired, by number; the tiles' bytes are attached afterwards. Within a pair only those runs of 128 whose block counts come near
enough are compared. There, numpy takes the exclusive or and the bit count of all pairs: the comparison is exact and has no cap. A tile keeps
which of its classes its own links connect, and returns a spanning forest of them; a pair of tiles returns only the links that connect
such parts, so a large group costs a link a tile pair. Components come from the forests: as long as there are more edges than a task takes, nodes
hook to their least neighbour and edges contract to what they hook to, each round written to the shared folder; one task unites the rest.

The comparison is quadratic in the number of distinct fingerprints; the tests of counts leave out most of it.

The pipeline's stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Its fingerprints are those of the sets, without repeats, and have 256 bits: at
0.8, about 39 of them differ, with a deviation of 6; candidates are pairs that differ in 64 at most, and in 20 at most of the first
64. Of texts without a common shingle 128 differ, with a deviation of 8, so chance makes no candidates, however many
texts there are. Each candidate's similarity is computed from the whole sets.

The stage doesn't compare all fingerprints. In whatever order all shingles stand, two sets of similarity 0.8 have one in common among the first of
each, a fifth of the set and one more; so only the texts on the list of one such shingle are compared, which leaves out no similar pair. The order is by how often a shingle
occurs (counted over all texts, in cells that shingles share), so what many texts quote comes last. Texts on a list of more than
``longest`` are compared all with all, in tiles. Lists and tiles first give forests of
candidates, those of few bits first; where these fall apart because a candidate isn't similar enough, all candidates between the
parts are compared in blocks, which return forests again.

Defined results: null and empty texts and texts without words have fingerprint zero, linked like any other; the
component's id is the smallest id that isn't null; repeated rows give repeated results; an empty table gives an
empty result; further columns are ignored, whatever their names. The stage keeps one row of each component: of those with the smallest id
(null last) the first; texts without words are one component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import discard, materialise, scratch, shuffle_partitions, table

RUN = 128


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number. bytes.lower() and bytes.split() know A-Z and \\x20\\x09-\\x0D only."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxh64_intdigest(b" ".join(tokens), seed)]
    else:
        joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones, h = np.zeros(64, np.int64), np.array(hashes, "<u8")
    for at in range(0, len(h), 16_384):
        ones += np.unpackbits(h[at : at + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def blocks(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit blocks."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tiles(classes: DataFrame, fps: list[str], most: int, *limits: tuple[int, int]) -> DataFrame:
    """(tile, pop, nodes, fps, parts, a, b): tiles of up to ``most`` classes (node long, the words of a fingerprint) of one population count of
    the first word; the part that each class is in by the tile's own links, and a spanning forest (a, b) of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, pop = TaskContext.get().partitionId(), 0, [], -1

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal k, held
            if held:
                own = np.concatenate(held)
                for at in range(0, len(own), most):
                    x = own[at : at + most]
                    nodes = np.ascontiguousarray(x[:, 0])
                    own_parts, a, b = forest(x[:, 1:], x[:, 1:], np.arange(len(x)), True, *limits)
                    columns = (nodes, np.ascontiguousarray(x[:, 1:]), own_parts.astype(np.int32), nodes[a], nodes[b])
                    yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([pop], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in columns)], ["tile", "pop", "nodes", "fps", "parts", "a", "b"])
                    k += 1
            held = []

        for batch in batches:
            pops, rows = batch.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
            for x in np.unique(pops):
                if x != pop or sum(map(len, held)) >= most:
                    yield from out()
                    pop = int(x)
                held.append(rows[pops == x])
        yield from out()

    first = fps[0]
    sorted_ = classes.select(F.bit_count(first).cast("int").alias("pop"), "node", *fps, *[F.bit_count(F.expr(f"shiftrightunsigned({first}, {s}) & 65535")).alias(f"b{s}") for s in (0, 16, 32, 48)])
    # by population count and fingerprint: a range boundary may split a count, so no count is too much for a task
    parts, by = max(6, classes.count() // most), ["pop", "b0", "b16", "b32", first, "node"]
    spread = sorted_.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return spread.select("pop", "node", *fps).mapInArrow(run, "tile long, pop int, nodes binary, fps binary, parts binary, a binary, b binary")


def near(a: np.ndarray, b: np.ndarray, same: bool, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of fingerprints (rows of words) that differ in at most ``radius`` bits of the first word and ``total`` in all."""
    ba, bb, starts = blocks(a[:, 0]), blocks(b[:, 0]), np.arange(0, len(b), RUN)
    low, high, first = np.minimum.reduceat(bb, starts), np.maximum.reduceat(bb, starts), np.ascontiguousarray(b[:, 0])
    for at in range(0, len(a), RUN):
        x = a[at : at + RUN]
        lo, hi = ba[at : at + RUN].min(0), ba[at : at + RUN].max(0)
        may = np.maximum(0, np.maximum(low - hi, lo - high)).sum(1) <= radius
        if same:
            may &= starts + RUN > at
        runs = np.flatnonzero(may)
        for part in range(0, len(runs), 64):
            cols = (starts[runs[part : part + 64], None] + np.arange(RUN)).ravel()
            cols = cols[cols < len(b)]
            i, j = np.nonzero(np.bitwise_count(x[:, 0, None] ^ first[cols]) <= radius)
            j = cols[j]
            if same:
                i, j = i[j > i + at], j[j > i + at]
            if a.shape[1] > 1:
                keep = np.bitwise_count(x[i] ^ b[j]).sum(1, dtype=np.int64) <= total
                i, j = i[keep], j[keep]
            if len(i):
                yield i + at, j


def forest(a: np.ndarray, b: np.ndarray, parts: np.ndarray, same: bool, *limits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, i, j): the links (i, j), as places in the tiles a and b (or within one), that a spanning forest needs to connect what ``parts``,
    numbers over both tiles, hold already; and the parts after that. Links under the first of the limits (radius, total) are taken before those
    under the next."""
    base, parent = 0 if same else len(a), parts.copy()
    left: list[int] = []
    right: list[int] = []

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (far := parent[up]) is not None and (far != up).any():
            up = far
        parent[x] = up
        return up

    for rows, cols in (x for limit in limits for x in near(a, b, same, *limit)):
        begin = np.flatnonzero(np.diff(rows, prepend=-1))
        for x, y in zip(begin, np.append(begin[1:], len(rows)), strict=True):
            mine = roots(rows[x : x + 1])[0]
            others, which = np.unique(roots(cols[x:y] + base), return_index=True)
            new = others != mine
            left += [int(rows[x])] * int(new.sum())
            right += cols[x:y][which[new]].tolist()
            parent[others] = mine
    return roots(np.arange(len(parent))), np.array(left, np.int64), np.array(right, np.int64)


def tile_pairs(tiled: DataFrame, radius: int, salts: int = 8) -> DataFrame:
    """Each two tiles whose population counts come near enough, once. Numbers are paired first, a hot count in ``salts`` parts; a pair of
    counts meets once, with the smaller count, or tile number, on the left."""
    left = tiled.select(F.col("tile").alias("ta"), F.pmod("tile", F.lit(salts)).alias("salt"), F.explode(F.expr(f"sequence(pop, least(64, pop + {radius}))")).alias("pop"), F.col("pop").alias("pa"))
    right = tiled.select(F.col("tile").alias("tb"), "pop", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    pairs = left.join(right, ["pop", "salt"]).filter((F.col("pa") < F.col("pop")) | (F.col("ta") < F.col("tb"))).select("ta", "tb")
    bytes_of = lambda x: tiled.select(F.col("tile").alias(f"t{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "fps", "parts")))
    both = pairs.join(bytes_of("a"), "ta").join(bytes_of("b"), "tb")
    spread = both.repartition(4 * shuffle_partitions(tiled.sparkSession), "ta", "tb")
    return spread.select(*(f"{c}_{x}" for c in ("nodes", "fps", "parts") for x in "ab"))


PER_GROUP = 24, 1 << 20  # groups of tiles at least, and classes of a group


def grouped_links(tiled: DataFrame, words: int, *limits: tuple[int, int]) -> DataFrame:
    """As ``links``, for a radius so wide that few pairs of tiles have counts too far apart: each tile gets a group, and goes once to each pair of
    groups, not to each pair of tiles."""

    def run(rows: pa.Table) -> pa.Table:
        own, same = rows["own"].to_numpy(), rows["x"][0] == rows["y"][0]
        left = own == rows["x"][0].as_py()

        def side(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nodes, fps, parts = ([np.frombuffer(rows[c][k].as_buffer(), t) for k in at.tolist()] for c, t in (("nodes", np.int64), ("fps", np.uint64), ("parts", np.int32)))
            begin = np.cumsum([0, *map(len, nodes)])
            return np.concatenate(nodes), np.concatenate(fps).reshape(-1, words), np.concatenate([p.astype(np.int64) + b for p, b in zip(parts, begin[:-1], strict=True)])

        if same or left.all() or not left.any():
            if not same:  # the other group has no tiles
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            na, a, parts = side(np.arange(len(own)))
            nb, b = na, a
        else:
            (na, a, parts_a), (nb, b, parts_b) = side(np.flatnonzero(left)), side(np.flatnonzero(~left))
            parts = np.concatenate((parts_a, parts_b + len(na)))
        _, i, j = forest(a, b, parts, same, *limits)
        return pa.table({"a": pa.array(na[i]), "b": pa.array(nb[j])})

    classes = tiled.agg(F.sum(F.length("nodes") / 8)).first()[0] or 0
    groups = max(PER_GROUP[0], int(classes // PER_GROUP[1]) + 1)
    by_size = Window.orderBy(F.length("nodes").desc(), "tile")
    own = tiled.select("tile", F.pmod(F.row_number().over(by_size) - 1, F.lit(groups)).alias("own"))
    spread = tiled.join(own, "tile").withColumn("other", F.explode(F.expr(f"sequence(0, {groups} - 1)")))
    spread = spread.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "nodes", "fps", "parts")
    return own_links(tiled).unionByName(spread.groupBy("x", "y").applyInArrow(run, "a long, b long"))


def own_links(tiled: DataFrame) -> DataFrame:
    """(a, b): the tiles' own forests."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c[k].as_buffer(), np.int64)) for c in batch.columns], ["a", "b"])

    return tiled.select("a", "b").mapInArrow(own, "a long, b long")


def links(tiled: DataFrame, words: int, *limits: tuple[int, int]) -> DataFrame:
    """(a, b): the tiles' own forests, and for each two of them the links that connect their parts, over nodes."""

    def between_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                na, nb, fa, fb, pa_, pb = (np.frombuffer(c[k].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, np.int64, np.uint64, np.uint64, np.int32, np.int32), strict=True))
                a, b = (x.reshape(-1, words) for x in (fa, fb))
                _, i, j = forest(a, b, np.concatenate((pa_, pb + len(na))).astype(np.int64), False, *limits)
                yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], ["a", "b"])

    across = tile_pairs(tiled, max(r for r, _ in limits)).mapInArrow(between_two, "a long, b long")
    return own_links(tiled).unionByName(across)


def united(pairs: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(names, up, kept): the nodes of pairs in order, for each the place of the least that they connect it with, and the pairs of a spanning forest."""
    names, at = np.unique(pairs, return_inverse=True)
    up, kept = list(range(len(names))), []
    for k, (x, y) in enumerate(at.reshape(-1, 2).tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    for x, y in enumerate(up):  # y is x or comes before it
        up[x] = up[y]
    return names, up, kept


def whole(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The pairs of all batches."""
    return np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches)])


MOST_EDGES = 1 << 19  # of a task


def spanning(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """Edges (a, b), written already, that connect what ``edges`` do: a spanning forest of every ``most`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = whole(batches)
        _, _, kept = united(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[kept, 0]), pa.array(pairs[kept, 1])], ["a", "b"])

    return edges.select("a", "b").repartition(max(1, -(-edges.count() // most))).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tag: str = "components", most: int = MOST_EDGES) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node reached. While there are over ``most`` edges, each node takes the
    least of its neighbours, and that one's least; then edges contract to these, and fewer are left for the next round. One task unites
    the rest, and the rounds' nodes take the roots of what they took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, up, _ = united(whole(batches))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[up])], ["node", "root"])

    left, rounds = materialise(edges.select("a", "b"), tag), []
    while left.count() > most:
        thin = materialise(spanning(left, most), tag)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("low")), tag)
        then = low.select(F.col("node").alias("low"), F.col("low").alias("root"))
        rounds.append(materialise(low.join(then, "low").select("node", "root"), tag))
        root_of = lambda x: rounds[-1].select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        ends = thin.join(root_of("a"), "a").join(root_of("b"), "b").filter("root_a != root_b")
        contracted = ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        contracted = materialise(contracted, tag)
        discard(left, thin, low)
        left = contracted
    roots = materialise(left.repartition(1).mapInArrow(run, "node long, root long"), tag)
    discard(left)
    for taken in reversed(rounds):
        then = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        above = materialise(taken.join(then, "root", "left").select("node", F.coalesce("top", "root").alias("root")), tag)
        discard(roots, taken)
        roots = above
    return roots


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, seed: int = 42, radius: int = 4, tile_size: int = 65_536) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row."""
    fps = materialise(fingerprints(docs, id_col, text_col, words, seed), "simhash-fps")
    classes = materialise(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    tiled = materialise(tiles(classes.withColumn("node", F.col("fp")), ["fp"], tile_size, (radius, 64)), "simhash-tiles")
    roots = components(links(tiled, 1, (radius, 64)), "simhash-components")
    discard(tiled)
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "first", "root")
    lead = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(lead, "root").select("fp", "component_id")
    of = materialise(classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-classes")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The 128-bit hashes of the shingles, repeats included, as two numbers each."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros((0, 2), np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    most = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-most])).tolist()
    return np.frombuffer(b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(starts, (ends[most - 1 :] - 1).tolist(), strict=True)]), np.uint64).reshape(-1, 2)


WIDE = "f0", "f1", "f2", "f3"  # the words of a wide fingerprint


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits don't follow those of x: a step of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """256 bits: 128 of the hashes of a set of shingles, and 128 of what mixing makes of them."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(h), 8192):
        x = h[at : at + 8192]
        ones += np.unpackbits(np.concatenate((x, mixed(x)), axis=1).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(s)) for k, s in (("a", "sa"), ("b", "sb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


PER_TASK = 2048, 8 << 20  # texts and bytes of their sets on either side of a comparison


def jaccard(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sets, as sorted numbers, are similar."""
    up, down = similarity
    if min(len(x), len(y)) * down < max(len(x), len(y)) * up:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return down * both >= up * (len(x) + len(y) - both)


CELL_BITS, BLOCK = 18, 4096  # leading bits of a shingle that name the cell it is counted in, and cells of a row of counts


def cells(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(counted: DataFrame) -> np.ndarray:
    """The sum of rows (block, counts), cell by cell."""

    def run(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in rows["counts"])
        return pa.table({"block": rows["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    often = np.zeros((1 << CELL_BITS) // BLOCK * BLOCK, np.int64)
    for r in counted.select("block", "counts").groupBy("block").applyInArrow(run, "block int, counts binary").collect():
        often[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return often


def rarest(own: np.ndarray, often: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set (numbers in order), by the counts of their cells: as many as a similar set may lack, and one. Similar sets have
    one of theirs in common: the first of all that they have in common."""
    up, down = similarity
    return own[np.argsort(often[cells(own)], kind="stable")[: len(own) + -len(own) * up // down + 1]]


PER_LIST, SHORT = 1 << 19, 64  # entries that a task holds, and those of a list whose pairs are taken without a look at their fingerprints


def lists(texts: DataFrame, shards: int, often: np.ndarray, similarity: tuple[int, int], words: int, longest: int) -> DataFrame:
    """(list, at, node): the nodes of ``texts`` (node, text) that have one of their rarest shingles in common, a list for each such set of nodes in a shard.
    Short lists of the same first node are for the same task (``at``). Nodes of lists of more than ``longest`` come without a list (-1)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []

        def out() -> pa.RecordBatch:
            shingles = np.concatenate([x for x, _ in held])
            nodes = np.repeat(np.array([n for _, n in held], np.int64), [len(x) for x, _ in held])
            shard = (shingles % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            own, begin = np.unique(shard[order], return_index=True)
            parts = [[y.tobytes() for y in np.split(x[order], begin[1:])] for x in (shingles, nodes)] if len(own) else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["shard", "shingles", "nodes"])

        size = 0
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                held.append((rarest(np.unique(shingle_hashes(t.as_py() or b"", words)[:, 0]), often, similarity), node))
                size += len(held[-1][0])
                if size >= PER_LIST:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def run(rows: pa.Table) -> pa.Table:
        shingles, nodes = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows[c]]) for c, t in (("shingles", np.uint64), ("nodes", np.int64)))
        order = np.argsort(shingles, kind="stable")
        shingles, nodes = shingles[order], nodes[order]
        begin = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
        length = np.diff(np.append(begin, len(nodes)))
        number, none, out = rows["shard"][0].as_py() << 40, np.zeros(0, np.int64), []
        for m in np.unique(length[length > 1]).tolist():
            same = np.unique(np.sort(nodes[begin[length == m][:, None] + np.arange(m)], axis=1), axis=0)
            if m > longest:
                own = np.unique(same)
                out.append((np.full(len(own), -1), own, own))
                continue
            numbers = number + np.arange(len(same))
            out.append((np.repeat(numbers, m), np.repeat(same[:, 0] if m <= SHORT else numbers, m), same.ravel()))
            number += len(same)
        columns = [np.concatenate([none, *x]) for x in zip(*out, strict=True)] if out else [none] * 3
        return pa.table(dict(zip(("list", "at", "node"), map(pa.array, columns), strict=True)))

    entered = texts.select("node", "text").mapInArrow(entries, "shard int, shingles binary, nodes binary")
    return entered.groupBy("shard").applyInArrow(run, "list long, at long, node long")


def reached(fps: np.ndarray, radius: int, total: int) -> np.ndarray:
    """A spanning forest, as pairs of places, of the fingerprints that come near each other: each is linked to the one it is first reached from."""
    left, rest, found = np.arange(len(fps)), fps, [np.zeros((0, 2), np.int64)]
    while len(left) > 1:
        todo, left, rest = [left[0]], left[1:], rest[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.flatnonzero(np.bitwise_count(rest[:, 0] ^ fps[x, 0]) <= radius)
            hit = hit[np.bitwise_count(rest[hit] ^ fps[x]).sum(1, dtype=np.int64) <= total]
            if len(hit):
                found.append(np.stack((np.full(len(hit), x), left[hit]), axis=1))
                todo += left[hit].tolist()
                left, rest = np.delete(left, hit), np.delete(rest, hit, axis=0)
    return np.concatenate(found)


def list_links(listed: DataFrame, classes: DataFrame, *limits: tuple[int, int]) -> DataFrame:
    """(a, b): forests, task by task, of the pairs under the limits that are on a list (list, at, node) together."""

    def run(rows: pa.Table) -> pa.Table:
        names, first, at = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
        fps = np.stack([rows[c].to_numpy().view(np.uint64)[first] for c in WIDE], axis=1)
        own = rows["list"].to_numpy()
        order = np.lexsort((at, own))
        own, at = own[order], at[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        length = np.diff(np.append(begin, len(own)))
        short = np.repeat(length <= SHORT, length)
        own, near_at, keys = own[short], at[short], [np.zeros(0, np.int64)]
        for d in range(1, SHORT):
            k = np.flatnonzero(own[:-d] == own[d:])
            keys.append(near_at[k] * len(names) + near_at[k + d])
        pairs, apart, whole_apart = np.stack(np.divmod(np.unique(np.concatenate(keys)), len(names)), axis=1), [], []
        for k in range(0, len(pairs), PER_LIST):
            a, b = pairs[k : k + PER_LIST].T
            bits = np.bitwise_count(fps[a] ^ fps[b])
            apart.append(bits[:, 0])
            whole_apart.append(bits.sum(1, dtype=np.int64))
        apart, whole_apart = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (apart, whole_apart))
        long = [at[x : x + n] for x, n in zip(begin.tolist(), length.tolist(), strict=True) if n > SHORT]
        found = [y for radius, total in limits for y in (pairs[(apart <= radius) & (whole_apart <= total)], *(x[reached(fps[x], radius, total)] for x in long))]
        found = names[np.concatenate(found)]
        _, _, kept = united(found)
        return pa.table({"a": found[kept, 0], "b": found[kept, 1]})

    groups = max(shuffle_partitions(listed.sparkSession), listed.count() // (PER_LIST // 4))
    entries = listed.withColumn("to", F.pmod(F.xxhash64("at"), F.lit(groups))).select("to", "list", "node")
    return entries.join(classes.select("node", *WIDE), "node").groupBy("to").applyInArrow(run, "a long, b long")


def between(parts: DataFrame, similarity: tuple[int, int], radius: int, total: int, most: tuple[int, int] = PER_TASK) -> DataFrame:
    """(a, b): links between the roots of each zone, from rows of (node, zone, root, the words of a fingerprint, shingles). All candidates between different roots are
    compared until they are connected, in blocks of a zone against each other, so a large zone is no task's alone; a task
    returns a spanning forest."""
    sizes = parts.groupBy("zone").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most[0]), F.ceil(F.sum(F.length("shingles")) / most[1])).alias("n"))
    blocks = parts.join(sizes, "zone").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
    blocks = blocks.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).select("zone", "x", "y", "own", "root", *WIDE, "shingles")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, root = np.unique(rows["root"].to_numpy(), return_inverse=True)
        fps = np.stack([rows[c].to_numpy().view(np.uint64) for c in WIDE], axis=1)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows["shingles"]]
        left = rows["own"].to_numpy() == rows["x"][0].as_py()
        same = rows["x"][0] == rows["y"][0]
        ia, ib = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        up, found = list(range(len(names))), []

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for i, j in near(fps[ia], fps[ib], same, radius, total) if len(ia) and len(ib) else ():
            i, j = ia[i], ib[j]
            cross = root[i] != root[j]
            for p, q in zip(i[cross].tolist(), j[cross].tolist(), strict=True):
                a, b = find(root[p]), find(root[q])
                if a != b and jaccard(sets[p], sets[q], similarity):
                    up[max(a, b)] = min(a, b)
                    found.append((names[root[p]], names[root[q]]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return blocks.groupBy("zone", "x", "y").applyInArrow(run, "a long, b long")


def similar_components(rows: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (4, 5), radius: int = 20, total: int = 64, tight: tuple[int, int] = (14, 36), tile_size: int = 65_536, longest: int = 2048) -> DataFrame:
    """(row, id, component) of rows (row, id, text): ``component`` is the same for texts that links of similar sets of shingles connect.
    ``tight``: the limits under which most candidates are similar."""
    types = {"row": pa.int64(), "id": pa.int64(), "key": pa.binary(), **dict.fromkeys(WIDE, pa.int64()), "n": pa.int64(), "block": pa.int32(), "counts": pa.binary()}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and after them rows of the counts of their shingles."""

        def filled(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()], list(types))

        often = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            keys, sets, fps = [], [], np.zeros((batch.num_rows, len(WIDE)), np.int64)
            for k, t in enumerate(batch.column(2).cast(pa.binary())):
                h = shingle_hashes(t.as_py() or b"", words)
                own, at = np.unique(h[:, 0], return_index=True)
                keys.append(xxh3_128_digest(own.tobytes()))
                sets.append(own)
                fps[k] = wide_fingerprint(h[at]).view(np.int64)
            if sets:
                often += np.bincount(cells(np.concatenate(sets)), minlength=len(often))
            yield filled(row=batch.column(0), id=batch.column(1), key=pa.array(keys, pa.binary()), n=pa.array(list(map(len, sets)), pa.int64()), **{c: pa.array(np.ascontiguousarray(x)) for c, x in zip(WIDE, fps.T, strict=True)})
        if often.any():
            counts = [x.tobytes() for x in often.astype(np.uint32).reshape(-1, BLOCK)]
            yield filled(block=pa.array(range(len(counts)), pa.int32()), counts=pa.array(counts, pa.binary()))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = [np.unique(shingle_hashes(t.as_py() or b"", words)[:, 0]).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "shingles"])

    marks = materialise(rows.select("row", "id", "text").mapInArrow(marked, f"row long, id long, key binary, {' long, '.join(WIDE)} long, n long, block int, counts binary"), "near-rows")
    often, fps = cell_counts(marks.filter("block IS NOT NULL")), marks.filter("block IS NULL").select("row", "id", "key", *WIDE, "n")
    classes = fps.groupBy("key").agg(F.min("row").alias("node"), *(F.min(c).alias(c) for c in (*WIDE, "n")))
    classes = materialise(classes, "near-classes")
    # of each class one text is listed: most often few are left out
    others = materialise(fps.join(classes.select("key", "node"), "key").filter("row != node").select("row"), "near-others")
    up, down = similarity
    entries = classes.agg(F.sum(F.col("n") * (down - up) / down + 1)).first()[0] or 0
    texts = rows.select("row", "text").join(others, "row", "left_anti").withColumnRenamed("row", "node")
    listed = lists(texts, max(shuffle_partitions(rows.sparkSession), int(entries) // PER_LIST + 1), often, similarity, words, longest)
    listed = materialise(listed, "near-lists")
    first = list_links(listed.filter("list >= 0"), classes, tight, (radius, total))
    crowd = materialise(listed.filter("list < 0").select("node").distinct(), "near-crowd")
    if not crowd.isEmpty():
        tiled = materialise(tiles(classes.join(crowd, "node", "left_semi"), list(WIDE), tile_size, tight, (radius, total)), "near-tiles")
        first = first.unionByName(grouped_links(tiled, len(WIDE), tight, (radius, total)))
    first = materialise(first.distinct(), "near-candidates")
    # the whole sets of the classes that have candidates, from the row that each class is named after
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    texts = rows.select(F.col("row").alias("node"), "text").join(nodes, "node", "left_semi")
    sets = materialise(texts.select("node", "text").mapInArrow(shingled, "node long, shingles binary"), "near-sets")
    linked = materialise(similar(first, sets, similarity), "near-links")
    roots = components(linked, "near-roots")
    of = classes.join(roots, "node", "left").select("key", "node", *WIDE, F.coalesce("root", "node").alias("root"))
    # where candidates of the forests aren't similar, all candidates between what links connect on either side are compared
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    failed = first.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    failed = materialise(failed.filter("a != b").distinct(), "near-failed")
    zones = components(failed, "near-zones").select(F.col("node").alias("root"), F.col("root").alias("zone"))
    parts = of.join(zones, "root").join(sets, "node").select("node", "zone", "root", *WIDE, "shingles")
    more = materialise(between(parts, similarity, radius, total), "near-links")
    if not more.isEmpty():
        tops = components(more, "near-tops").select(F.col("node").alias("root"), F.col("root").alias("top"))
        of = of.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root"))
    of = of.select("key", F.col("root").alias("component"))
    return fps.join(of, "key").select("row", "id", "component")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with all its columns."""
    row = f"row_{uuid.uuid4().hex}"
    tagged = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    rows = tagged.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        found = materialise(similar_components(rows), "near-components", keep=True)
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    leads = found.join(least, "component").filter(F.col("id").eqNullSafe(F.col("least"))).groupBy("component").agg(F.min("row").alias(row)).select(row)
    return tagged.join(leads, row, "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
