import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tickloom.llm import queries
from tickloom.llm.common import discard, materialise, scratch
from tickloom.llm.langid import op1_langid
from tickloom.llm.mixing import mixing_sql
from tickloom.llm.sampled_pieces import decode_pieces

from .test_simhash import plain_near

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "simhash", "mixing", "pieces"]
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries()) and set(queries.SQL) <= set(driver.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run_against_plain_stages(spark):
    """The rows of ``run`` from the rejections of the language query, a dictionary of texts, all pairs of sets of shingles, and SQL."""
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rejected = {r.doc_id for r in op1_langid(spark, SF).filter("rejected").collect()}
    left = sorted(set(texts) - rejected)
    first = {}
    for i in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i].text or ""), i)
    left = sorted(first.values())
    roots = plain_near([texts[i].text for i in left])
    left = [i for k, i in enumerate(left) if roots[k] == k]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE kept (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO kept VALUES (?, ?, ?, ?)", [(i, texts[i].text, texts[i].lang, texts[i].source) for i in left])
    want = Counter(dict(duck.execute(f"WITH {mixing_sql('kept', (9, 10))} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall()))
    rows = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in rows.collect()) == want and 0 < len(want) < len(texts)
    assert all(r.text == texts[r.doc_id].text for r in decode_pieces(rows).collect())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_scratch_tables_go(spark):
    there = lambda df: Path(df._shared_path.removeprefix("file:")).exists()
    with scratch(spark):
        with scratch(spark):
            gone, kept = materialise(spark.range(3), "a"), materialise(spark.range(3), "b", keep=True)
        assert kept.count() == 3 and there(kept) and not there(gone)
        last = materialise(spark.range(3), "c", keep=True)
    assert there(last) and not there(kept)
    discard(last)
    assert not there(last)


def test_the_rest_works_without_this_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tickloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import importlib

    alone = importlib.import_module("__spark_entry__")
    assert alone.llm is None and "q_metric" in alone.queries() and "pipeline" not in alone.queries() and alone.oracle_sql()
