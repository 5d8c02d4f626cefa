import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm.langid import fit, held_out, langid_stage, op1_langid, tag, train_rows

from .odd import odd_texts

PARTS = {"aa": ["the", "ing", "th", "ou", "sh", "ea"], "bb": ["der", "ich", "ung", "sch", "ei", "zu"], "cc": ["que", "ión", "ar", "os", "la", "ez"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang, "s"))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_held_out_accuracy_and_edges(spark, corpus):
    model = fit(train_rows(corpus), k=2, sample_per_lang=50)
    assert sorted(set(model[0])) == ["aa", "bb", "cc"] and 3 <= len(model[0]) <= 6
    rows = tag(corpus, model).withColumn("out", held_out(F.col("doc_id"), 4, 2)).collect()
    tested = [r for r in rows if r.out and r.lang]
    assert len(tested) > 80 and sum(r._lang_pred == r.lang for r in tested) / len(tested) > 0.97
    assert all(0 <= r._score <= 1 for r in rows)
    odd = {r.doc_id - 1000: r for r in rows if r.doc_id >= 1000}
    for i, t in enumerate(odd_texts()):
        letters = any(map(str.isalpha, t or ""))
        assert (odd[i]._lang_pred == "und") == (not letters) and (letters or odd[i]._rejected)


def test_predictions_depend_on_text_only(spark, corpus):
    model = fit(train_rows(corpus), k=2, sample_per_lang=50)
    moved = corpus.select((F.col("doc_id") * 7).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"))
    a, b = ({(r.text, r._lang_pred, r._score) for r in tag(x, model).collect()} for x in (corpus, moved))
    assert a == b


def test_no_training_rows_and_no_rows(corpus):
    model = fit(train_rows(corpus.filter("lang IS NULL")))
    assert {r._lang_pred for r in tag(corpus.limit(5), model).collect()} == {"und"}
    assert tag(corpus.limit(0), fit(train_rows(corpus), sample_per_lang=20)).count() == 0


def test_stage_and_query(spark, corpus, tmp_path):
    kept = langid_stage(spark, corpus, "")
    assert kept.columns == corpus.columns and kept.filter("lang IS NOT NULL").count() == 600
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_langid(spark, str(tmp_path))
    assert out.count() == corpus.count() and out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]


def test_columns_that_clash(spark, corpus):
    docs = corpus.limit(40).withColumns({"_score": F.lit("kept"), "_Rejected": F.lit(7), "__score": F.lit(1)})
    kept = langid_stage(spark, docs, "")
    assert kept.columns == docs.columns and {(r._score, r._Rejected) for r in kept.collect()} == {("kept", 7)}


def plain_counts(text):
    """Trigram slots by the rules of the module's docstring, one byte at a time."""
    data = [32, *(b if b >= 128 else (b | 32 if 65 <= b & ~32 <= 90 else 32) for b in (text or "").encode()), 32]
    out = Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if (a, b, c) != (32, 32, 32):
            out[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20] += 1
    return out


def test_predictions_against_a_plain_version(spark, corpus):
    """From texts to scores, with one centroid for each language: the mean direction of its training rows."""
    rows = [r for r in corpus.collect() if r.text is None or len(r.text) < 6000]
    training = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    seen = Counter(s for r in training for s in plain_counts(r.text))

    def vector(text):
        v = {s: math.log1p(n) * math.log((1 + len(training)) / (1 + seen[s])) for s, n in plain_counts(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {s: x / max(size, 1e-9) for s, x in v.items()}

    centroids = {}
    for lang in PARTS:
        total = Counter()
        for r in training:
            if r.lang == lang:
                total.update(vector(r.text))
        size = math.sqrt(sum(x * x for x in total.values()))
        centroids[lang] = {s: x / size for s, x in total.items()}
    model = fit(train_rows(spark.createDataFrame(rows, corpus.schema)), k=1, sample_per_lang=10_000)
    for r in tag(spark.createDataFrame(rows, corpus.schema), model).collect():
        v = vector(r.text)
        cosine = {lang: sum(x * c.get(s, 0.0) for s, x in v.items()) for lang, c in centroids.items()}
        best = max(sorted(cosine), key=cosine.get)
        letters = any(map(str.isalpha, r.text or ""))
        assert r._score == pytest.approx(max(0.0, cosine[best]) if letters else 0.0, abs=1e-4)
        assert r._lang_pred == ("und" if not letters else best) or letters and sorted(cosine.values())[-1] - sorted(cosine.values())[-2] < 1e-4


def test_unseen_long_texts_are_rejected_and_own_ones_of_any_length_kept(spark):
    rng = random.Random(8)
    make = lambda parts, n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(PARTS[lang], rng.choice([4, 20, 100, 400])), lang, "s") for i in range(400) for lang in [("aa", "bb")[i % 2]]]
    model = fit(train_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), k=2)
    other = [make(PARTS["cc"], n) for n in (100, 400, 2000) for _ in range(20)]
    other += ["".join(rng.choices(pool, k=n)) for pool in ("ABCDEFGHIJabcdefghijklmnopqrstuvwxyz0123456789+/", [chr(c) for c in range(0x4E00, 0x9FA0)], [chr(c) for c in range(0x430, 0x450)] + [" "]) for n in (600, 2000, 8000) for _ in range(10)]
    own = [make(PARTS[lang], n) for lang in ("aa", "bb") for n in (4, 20, 100, 400, 2000) for _ in range(20)]
    flags = {n: [r._rejected for r in tag(spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string"), model).collect()] for n, x in (("other", other), ("own", own))}
    assert all(flags["other"]) and sum(flags["own"]) <= 0.02 * len(own)
