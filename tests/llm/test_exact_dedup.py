import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql.functions import lit

from tickloom.llm.exact_dedup import dedup_stage, directory, exact_dedup, routed

from .odd import odd_texts


def plain(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in sorted(norm.items()):
        groups.setdefault(t, []).append(i)
    return {i: (groups[t][0], len(groups[t]), i == groups[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("bits", [64, 1])
def test_against_a_plain_version(docs_of, bits):
    texts = odd_texts() + [f"text {i % 7}" for i in range(60)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs_of(texts), hash_bits=bits).collect()}
    assert got == plain(list(enumerate(texts)))


def test_buckets_split_when_they_are_full(docs_of):
    rows = exact_dedup(docs_of([f"t {i}" for i in range(200)]), bucket_entries=20).select("bucket", "link").collect()
    sizes = Counter(r.bucket for r in rows)
    assert len(sizes) > 8 and max(sizes.values()) <= 20 and {r.link for r in rows} == {1}


def test_the_directory_doubles_where_a_bucket_is_full(spark):
    keys = [1 << 57, 2 << 57, 3 << 57, 7 << 60, -1, -(1 << 60), 1 << 62]
    buckets, depths = directory(spark.createDataFrame([(k,) for k in keys], "key long"), 2)
    found = {(r.depth, r.prefix, r.bucket) for r in buckets.collect()}
    assert max(depths) == 6 and all(sum(f"{k % 2**64:064b}".startswith(f"{p:0{d}b}" if d else "") for d, p, _ in found) == 1 for k in keys)
    assert {r.key: r.bucket for r in routed(spark.createDataFrame([(k,) for k in keys], "key long"), buckets, depths).collect()}.keys() == set(keys)
    many = directory(spark.createDataFrame([(7,)] * 50, "key long"), 2)[0].collect()
    assert len(many) == 1  # one key can't be split


def test_chains(docs_of):
    assert max(r.link for r in exact_dedup(docs_of([f"t {i}" for i in range(50)]), hash_bits=2).collect()) > 5


def test_empty_and_stage(spark, docs_of):
    assert exact_dedup(docs_of(["a"]).limit(0)).count() == 0
    docs = docs_of(["a b", "a  b", None, "", "c"]).withColumn("_dedup_sha", lit("as it was"))
    kept = dedup_stage(spark, docs, "")
    assert {r._dedup_sha for r in kept.collect()} == {"as it was"}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.kept) for r in exact_dedup(docs).collect()) == [(-1, -1, True), (-1, 3, False), (3, 3, True)]
