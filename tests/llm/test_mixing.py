import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tickloom.llm.mixing import deal as deal_nodes
from tickloom.llm.mixing import LEVELS, mix, mixing_stage, tokens, with_leaves

from .odd import odd_texts


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def deal(budget, caps, weights):
    """Fill in proportion to weights, to no child more than its cap."""
    got, open_ = dict.fromkeys(caps, Fraction(0)), set(caps)
    left = Fraction(budget)
    while open_ and left > 0:
        w = sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] - got[c] <= left * weights[c] / w}
        if not full:
            for c in open_:
                got[c] += left * weights[c] / w
            break
        for c in full:
            left -= caps[c] - got[c]
            got[c] = Fraction(caps[c])
        open_ -= full
    return got


def test_tokens(docs_of):
    texts = odd_texts()
    got = {r.doc_id: r.n for r in docs_of(texts).select("doc_id", tokens(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_supplies_per_weight_that_doubles_cannot_tell_apart(spark):
    """10**17 + 1 tokens at weight 1 and 2 * 10**17 + 1 at weight 2: the second comes first, so the first gets the rest of rounding."""
    nodes = spark.createDataFrame([("a", 10**17 + 1, 1), ("b", 2 * 10**17 + 1, 2)], "node string, cap long, weight long")
    nodes = nodes.select("node", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("cap", "weight")), (2 / F.col("weight")).cast("decimal(18,0)").alias("scale"), F.lit(3 * 10**17 + 1).cast("decimal(38,0)").alias("_budget"))
    assert {r.node: int(r.budget) for r in deal_nodes(nodes, [], "node").collect()} == {"a": 10**17 + 1, "b": 2 * 10**17}


def test_budgets_and_prefixes_against_a_plain_version(spark):
    weights = {"_mix_domain": {"d0": 5, "d1": 1}, "_mix_lang": {"en": 3}, "_mix_source": {}}
    rows = [(i, " ".join(["w"] * (1 + i * i % 40)), ["en", "de", None][i % 3], f"s{i % 11}") for i in range(400)]
    docs = with_leaves(rows_of(spark, rows)).withColumn("_mix_tokens", tokens(F.col("text")))
    out = mix(docs, weights=weights, share=(4, 5), max_epochs=3, seed=1).collect()
    supply, members = defaultdict(int), defaultdict(list)
    for r in out:
        leaf = tuple(r[c] for c in LEVELS)
        supply[leaf] += r._mix_tokens
        members[leaf].append(r)
    caps = {k: 3 * v for k, v in supply.items()}
    w = lambda level, name: weights[LEVELS[level]].get(name, 1)
    budget = {(): Fraction(sum(supply.values()) * 4 // 5)}
    for level in range(3):
        for parent in [k for k in budget if len(k) == level]:
            children = {k[: level + 1] for k in caps if k[:level] == parent}
            sums = {c: sum(v for k, v in caps.items() if k[: level + 1] == c) for c in children}
            budget |= deal(budget[parent], sums, {c: w(level, c[-1]) for c in children})
    for leaf, own in members.items():
        b = own[0]._mix_budget
        assert abs(b - budget[leaf]) <= 3, (leaf, b, float(budget[leaf]))
        whole, rest = b // supply[leaf], b % supply[leaf]
        total = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"1:{whole}:{r.doc_id}".encode()).hexdigest()):
            total += r._mix_tokens
            assert r._mix_copies == whole + (total <= rest)
    assert sum(m[0]._mix_budget for m in members.values()) == sum(supply.values()) * 4 // 5


def test_shortages_go_to_siblings_first(spark):
    text = lambda n: " ".join(["w"] * n)
    # s0 and s4 share a domain (0 and 4 by their last character), s1 has its own
    rows = [(0, text(10), "en", "s0"), *[(i, text(10), "en", "s4") for i in range(1, 30)], *[(i, text(10), "en", "s1") for i in range(30, 60)]]
    docs = with_leaves(rows_of(spark, rows)).withColumn("_mix_tokens", tokens(F.col("text")))
    out = {r._mix_source: r._mix_budget for r in mix(docs, weights={}, share=(1, 2), max_epochs=1).collect()}
    assert out == {"s0": 10, "s4": 140, "s1": 150}


def test_odd_rows_and_stage(spark, docs_of):
    docs = docs_of(odd_texts())
    taken = mixing_stage(spark, docs, "")
    assert taken.columns == docs.columns and 0 < taken.count() <= 2 * docs.count()
    assert mixing_stage(spark, docs.limit(0), "").count() == 0
    nulls = rows_of(spark, [(1, "a b", None, None), (2, None, None, None)])
    assert mixing_stage(spark, nulls, "", share=(1, 1)).count() == 2
