import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tickloom.llm import simhash
from tickloom.llm.simhash import between, components, fingerprint, forest, grouped_links, simhash_components, simhash_stage, similar_components, spanning, tiles, wide_fingerprint

from .odd import odd_texts


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(fps, radius=4):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in fps}


def test_fingerprints():
    for t in [*odd_texts(), "One two THREE four five Ünicode Six", "a b c", "a b c d"]:
        assert fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_a_forest_has_the_links_components():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for s in seeds]))
    for radius in (2, 4, 30):
        parts, *found = forest(fps[:, None], fps[:, None], np.arange(len(fps)), True, (radius, 64))
        a, b = (fps[x] for x in found)
        assert len(set(parts.tolist())) == len(fps) - len(a)
        want = plain({int(f): int(f) for f in fps}, radius)
        got = {int(f): int(f) for f in fps}
        for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)) * len(fps):
            m = min(got[x], got[y])
            changed = got[x] != m or got[y] != m
            got[x] = got[y] = m
            if not changed:
                continue
        assert len(a) == len(fps) - len(set(want.values()))
        assert set(Counter(want.values()).values()) == set(Counter(want[int(f)] for f in fps).values())


def test_spanning_edges_connect_the_same(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [(-5, 2**62)]
    edges = spark.createDataFrame(rows, "a long, b long")
    for most in (1000, 40):
        found = spanning(edges, most).collect()
        assert len(found) <= 61 * -(-len(rows) // most) and {tuple(r) for r in found} <= set(rows)
        root = {x: x for r in rows for x in r}
        for a, b in [tuple(r) for r in found]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        assert all(root[a] == root[b] for a, b in rows)
    assert spanning(edges.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    n = 60
    nodes = list(range(n))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:], strict=False)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_components_over_several_tasks(spark, most):
    rng = random.Random(most)
    path = rng.sample(range(1000), 300)
    rows = [(x, y) for x, y in zip(path, path[1:], strict=False) if rng.random() < 0.9]
    rows += [(2000, 2000 + k) for k in range(1, 60)] + [(3000 - k, 3000) for k in range(1, 60)] + [(rng.randrange(4000, 4050), rng.randrange(4000, 4050)) for _ in range(80)]
    rows += [(-5, 2**62), (9000, 9000)]
    want = {x: x for r in rows for x in r}
    for a, b in rows:
        low, high = sorted((want[a], want[b]))
        want = {k: low if v == high else v for k, v in want.items()}
    got = components(spark.createDataFrame(rows, "a long, b long"), most=most).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_components_join_few_rows(spark):
    """Edges that fit a task are written and united, however far a label would have to travel."""
    from tickloom.llm import simhash

    n, written, old = 3000, [], simhash.materialise
    nodes = list(range(n))
    random.Random(2).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "materialise", lambda *a, **k: written.append(old(*a, **k)) or written[-1])
        assert {r.root for r in components(edges).collect()} == {0}
    assert len(written) == 2


def test_against_a_plain_version(spark, docs_of):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = odd_texts()
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    roots = plain(want)
    docs = docs_of(texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs, tile_size=16).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in want.items()}

def test_empty(docs_of):
    assert simhash_components(docs_of(["a"]).limit(0)).count() == 0


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = odd_texts()
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 220))]
        for _ in range(60 if group == 0 else 6):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def test_similar_components_against_all_pairs(docs_of):
    texts = near_copies()
    want = plain_near(texts)
    assert len(set(want)) < len(set(map(frozenset, map(plain_set, texts))))
    rows = docs_of(texts).selectExpr("doc_id AS row", "doc_id AS id", "text")
    found = similar_components(rows, tile_size=64).collect()
    first = {}
    for r in sorted(found):
        first.setdefault(r.component, r.id)
    assert {r.id: first[r.component] for r in found} == dict(enumerate(want))


@pytest.mark.parametrize("most", [(2048, 8 << 20), (5, 1 << 20)])
def test_parts_that_fall_apart_are_compared(docs_of, monkeypatch, most):
    """With a similarity that few candidates reach, all candidate pairs count."""
    monkeypatch.setattr(between, "__defaults__", (most,))
    texts = near_copies()
    sets = [plain_set(t) for t in texts]
    found = {r.id: r.component for r in similar_components(docs_of(texts).selectExpr("doc_id AS row", "doc_id AS id", "text"), similarity=(19, 20)).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 20 >= len(a | b) * 19:
                assert found[i] == found[j], (i, j)
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 20 >= len(a | b) * 19:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(set(found.values())) == len(set(root))


def test_repeats_do_not_hide_similar_sets(docs_of):
    """Sets of shingles are compared, so what a text repeats doesn't count."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(20):
        base, line = [rng.choice(words) for _ in range(150)], [rng.choice(words) for _ in range(12)]
        texts += [" ".join(base + line), " ".join(base + line * 60)]
    want = plain_near(texts)
    assert len(set(want)) == 20
    found = {r.id: r.component for r in similar_components(docs_of(texts).selectExpr("doc_id AS row", "doc_id AS id", "text")).collect()}
    assert all(found[i] == found[i + 1] for i in range(0, 40, 2)) and len(set(found.values())) == 20


def test_a_tile_goes_once_to_each_pair_of_groups(spark):
    """However many tiles there are, the bytes that travel don't grow with them, and no link between tiles is lost."""
    rng = np.random.default_rng(8)
    fps = np.repeat(rng.integers(0, 2**63, (60, 4)), 8, axis=0) ^ (1 << rng.integers(0, 62, (480, 4)))
    classes = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(fps)], "node long, f0 long, f1 long, f2 long, f3 long")
    tiled = tiles(classes, ["f0", "f1", "f2", "f3"], 4, (14, 36), (20, 64)).localCheckpoint()
    assert tiled.count() > 100
    found = grouped_links(tiled, 4, (14, 36), (20, 64))
    root = list(range(480))
    for a, b in found.collect():
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert root == [k - k % 8 for k in range(480)] and found.count() < 480 + 60 * 8 * 8


def quoting_texts(n=150):
    """Texts that all quote a line of a sixth of their words; of each third one there is a near copy."""
    rng = random.Random(21)
    line, texts = [f"line{i}" for i in range(30)], []
    for k in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(base + line)] + [" ".join([*base[:-1], "other", *line])] * (k % 3 == 0)
    return texts


def test_texts_without_a_rare_shingle_in_common_are_not_compared(docs_of, monkeypatch):
    """The comparison doesn't grow with the square of the input: unrelated texts never meet."""
    met, old, texts = [], simhash.tiles, quoting_texts()
    monkeypatch.setattr(simhash, "tiles", lambda classes, *rest: met.append(classes.count()) or old(classes, *rest))
    found = {r.id: r.component for r in similar_components(docs_of(texts).selectExpr("doc_id AS row", "doc_id AS id", "text")).collect()}
    assert not met
    want = plain_near(texts)
    assert len(set(want)) == 150 and all((found[i] == found[j]) == (want[i] == want[j]) for i in found for j in found)


def test_what_many_texts_quote_makes_no_long_lists(docs_of):
    texts = quoting_texts()
    rows, sets = docs_of(texts).selectExpr("doc_id AS node", "text"), [np.unique(simhash.shingle_hashes(t.encode(), 5)[:, 0]) for t in texts]
    often = np.bincount(simhash.cells(np.concatenate(sets)), minlength=1 << simhash.CELL_BITS)
    near = {(i, i + 1) for i, t in enumerate(texts[1:]) if " other " in t}
    for counts, most in ((often, 2), (np.zeros_like(often), len(texts))):
        found = {}
        for r in simhash.lists(rows, 3, counts, (4, 5), 5, 2048).collect():
            found.setdefault(r["list"], []).append(r.node)
        pairs = {tuple(sorted(x)) for x in found.values()}
        assert near <= pairs and max(map(len, pairs)) == most and (most > 2 or pairs == near)


@pytest.mark.parametrize("longest", [1, 4, 30])
def test_texts_on_long_lists_are_compared_in_tiles(docs_of, monkeypatch, longest):
    met, old, texts = [], simhash.tiles, near_copies()
    monkeypatch.setattr(simhash, "tiles", lambda classes, *rest: met.append(classes.count()) or old(classes, *rest))
    found = {r.id: r.component for r in similar_components(docs_of(texts).selectExpr("doc_id AS row", "doc_id AS id", "text"), tile_size=16, longest=longest).collect()}
    want = plain_near(texts)
    assert 1 < met[0] < len(set(texts)) and all((found[i] == found[j]) == (want[i] == want[j]) for i in found for j in found)


def test_similar_sets_have_a_rare_shingle_in_common():
    rng = np.random.default_rng(6)
    often = rng.integers(0, 3, 1 << simhash.CELL_BITS)
    for up, down in ((4, 5), (19, 20), (1, 2)):
        close = 0
        for _ in range(4000):
            every = np.unique(rng.integers(0, 2**64, rng.integers(1, 40), dtype=np.uint64))
            x, y = (every[rng.random(len(every)) < rng.choice([0.8, 0.9, 0.95])] for _ in range(2))
            if len(x) and len(y) and simhash.jaccard(x, y, (up, down)):
                close += 1
                assert len(np.intersect1d(simhash.rarest(x, often, (up, down)), simhash.rarest(y, often, (up, down))))
        assert close > 100
    assert not len(simhash.rarest(np.zeros(0, np.uint64), often, (4, 5)))


@pytest.mark.parametrize("short", [2, 64])
def test_forests_of_lists(spark, monkeypatch, short):
    """The pairs under the limits that share a list, and no others, are connected; short and long lists alike."""
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(9)
    fps = np.repeat(rng.integers(0, 2**63, (8, 4)), 6, axis=0) ^ (1 << rng.integers(0, 62, (48, 4)))
    classes = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(fps)], "node long, f0 long, f1 long, f2 long, f3 long")
    listed = {k: sorted(rng.choice(48, rng.integers(2, 12), replace=False).tolist()) for k in range(25)}
    frame = spark.createDataFrame([(k, x[0] if len(x) <= short else k, n) for k, x in listed.items() for n in x], "list long, at long, node long")
    wide, root = fps.view(np.uint64), list(range(48))

    def unite(a, b):
        low, high = sorted((root[a], root[b]))
        root[:] = [low if r == high else r for r in root]

    for x in listed.values():
        for a in x:
            for b in x:
                if np.bitwise_count(wide[a] ^ wide[b]).sum() <= 64:
                    unite(a, b)
    want, root[:] = list(root), range(48)
    for a, b in simhash.list_links(frame, classes, (14, 36), (20, 64)).collect():
        assert a // 6 == b // 6
        unite(a, b)
    assert root == want and len(set(want)) < 48


def test_chance_makes_no_candidates():
    """The share of bits in which texts without a common shingle come near is far below one in all pairs of a large corpus."""
    rng = np.random.default_rng(4)
    fps = np.stack([wide_fingerprint(rng.integers(0, 2**64, (rng.integers(20, 300), 2), dtype=np.uint64)) for _ in range(3000)])
    apart = np.concatenate([np.bitwise_count(fps[k] ^ fps[k + 1 :]).sum(1, dtype=np.int64) for k in range(len(fps) - 1)])
    total = similar_components.__kwdefaults__["total"]
    assert apart.mean() - 7.5 * apart.std() > total


def test_the_stage_drops_near_copies_at_eight_tenths(spark, docs_of):
    texts = near_copies()
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs_of(texts), "")
    assert kept.columns == docs_of(texts).columns and {r.doc_id for r in kept.collect()} == set(plain_near(texts))
    assert simhash_stage(spark, docs_of(texts).limit(0), "").count() == 0


def test_the_stage_keeps_one_row_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (3, "x y z"), (None, "only"), (None, None), (4, "")]
    kept = simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "only"), (3, "a b c"), (3, "x y z"), (4, "")]
