"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams (A-Z in lower case, other ASCII that isn't a letter as a space), weighted by
log(1 + count) and the inverse document frequency, of length one. Each language has several centroids, clustered by
spherical k-means, since its texts differ in kind and length. The nearest centroid by cosine gives the language;
a text farther than ``reject_distance`` (1 - cosine) from all centroids is rejected, and so is one whose cosine is under what its
language's own texts reach at its length. Long texts of any kind share slots by chance, so that floor is calibrated by length: each fifth of a
language's sample is left out of clusters made for this only, and cut to several lengths; the floor is a share of the
lowest hundredth of the cosines at each length, of the language or, where it has too few rows, of all together.

Document frequencies are counted over all training rows. The clusters are fitted on a bounded sample: the
``sample_per_lang`` training rows of a language with the smallest seeded hashes, about. Only text and lang are used.

Defined results: a text that is null or has no letter is "und", score 0, rejected; rows with a null lang don't train; without
training rows all is "und"; equal cosines go to the language first in the alphabet; repeated rows get equal results;
an empty table gives an empty result; further columns pass through ``tag`` and are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, utf8

SLOTS = 4096
CUTS = tuple(4**i for i in range(2, 9))  # bytes
QUANTILE, SHARE, FEWEST = 0.01, 0.75, 100
FEW_LANGS = 10_000
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def counts(column: pa.Array, at_once: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, trigram counts by row) for runs of rows."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets, 1 << 21):
        part = np.full(int(offsets[b] - offsets[a]) + b - a + 1, 32, np.uint32)  # a space around each text
        part[np.arange(offsets[a], offsets[b]) - offsets[a] + np.repeat(np.arange(1, b - a + 1), np.diff(offsets[a : b + 1]))] = FOLD[data[offsets[a] : offsets[b]]]
        key = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        slot = ((key * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        slot[key == 0x202020] = SLOTS  # runs of what isn't a letter
        ends = offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)
        for k in range(a, b, at_once):
            m = min(k + at_once, b) - k
            out = np.zeros((m, SLOTS), np.float32)
            for row, x, y in zip(out, ends[k - a :], ends[k - a + 1 : k - a + m + 1], strict=False):
                row[:] = np.bincount(slot[x : max(x, y - 1)], minlength=SLOTS + 1)[:SLOTS]
            yield k, out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)


def clusters(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, begun from the rows farthest from those taken before."""
    taken = [int(np.argmax(v @ v.mean(0)))]
    near = v @ v[taken[0]]
    while len(taken) < min(k, len(v)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[taken[-1]])
    c = v[taken].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / max(float(np.sqrt((m * m).sum())), 1e-9)
    return c.astype(np.float32)


def left_out(texts: list[str], v: np.ndarray, idf: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of CUTS, (trigrams, cosine) of texts cut to it, by clusters made without them."""
    out: list[list[np.ndarray]] = [[np.zeros((0, 2))] for _ in CUTS]
    full, fold = (v != 0).any(1), np.arange(len(v)) % 5
    for f in range(5):
        if not (full & (fold != f)).any():
            continue
        c = clusters(v[full & (fold != f)], k)
        held = [texts[i].encode() for i in np.flatnonzero(full & (fold == f))]
        for found, cut in zip(out, CUTS, strict=True):
            for _, tf in counts(pa.array([t[:cut] for t in held if len(t) >= cut], pa.binary())):
                found.append(np.stack([tf.sum(1), (vectors(tf, idf) @ c.T).max(1)], axis=1))
    return [np.concatenate(x) for x in out]


def floors(by_lang: list[list[np.ndarray]]) -> list[list[tuple[float, float]]]:
    """(trigrams, least cosine) of each language at the lengths of which there are enough texts."""
    out: list[list[tuple[float, float]]] = [[] for _ in by_lang]
    for at in range(len(CUTS) if by_lang else 0):
        pool = np.concatenate([x[at] for x in by_lang])
        for own, low in zip((x[at] for x in by_lang), out, strict=True):
            part = own if len(own) >= FEWEST else pool
            if len(part) >= FEWEST:
                low.append((float(np.median(part[:, 0])), SHARE * float(np.quantile(part[:, 1], QUANTILE))))
    return out


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each slot occurs, and the number of texts: SLOTS + 1 numbers for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for _, tf in counts(batch.column(0)):
                df[:SLOTS] += (tf > 0).sum(0)
                df[SLOTS] += len(tf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(df)], ["slot", "df"])

    rows = train.select("text").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(SLOTS + 1)
    for slot, n in rows:
        df[slot] = n
    return df[:SLOTS], int(df[SLOTS])


def fit(train: DataFrame, *, k: int = 4, sample_per_lang: int = 1000) -> tuple[list[str], np.ndarray, np.ndarray, list[list[tuple[float, float]]]]:
    """(language of each centroid, centroids, idf, floors of each centroid's language) from rows of (doc_id, text, lang); doc_id only draws the sample."""
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    seeded = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40)).cast("double")
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(FEW_LANGS + 1).count() <= FEW_LANGS  # else Spark joins as it sees fit
    part = train.join(F.broadcast(sizes) if few else sizes, "lang").filter(seeded * F.col("n") < F.lit(float(sample_per_lang << 40)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"]).iloc[: 2 * sample_per_lang]
        v = np.concatenate([vectors(tf, idf) for _, tf in counts(pa.array(group["text"], pa.string()))])
        c = clusters(v[(v != 0).any(1)], k) if (v != 0).any() else v[:0]
        held = b"".join(np.insert(x, 0, i, axis=1).tobytes() for i, x in enumerate(left_out(group["text"].tolist(), v, idf, k)))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(c), "centroid": [x.tobytes() for x in c], "held": [held if i == 0 else b"" for i in range(len(c))]})

    rows = sorted(part.select("doc_id", "text", "lang").groupBy("lang").applyInPandas(run, "lang string, centroid binary, held binary").collect())
    held = {r[0]: np.frombuffer(r[2]).reshape(-1, 3) for r in rows if r[2]}
    low = dict(zip(held, floors([[x[x[:, 0] == i, 1:] for i in range(len(CUTS))] for x in held.values()]), strict=True))
    return [r[0] for r in rows], np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(-1, SLOTS), idf, [low.get(r[0], []) for r in rows]


def least_cosines(low: list[list[tuple[float, float]]], best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The floor of each text by its centroid and its number of trigrams."""
    out = np.zeros(len(best))
    for i in np.unique(best):
        at, least = zip((0, 0.0), *low[i], strict=True)
        out[best == i] = np.interp(np.log1p(sizes[best == i]), np.log1p(at), least)
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    out = []
    for t in column:
        t = t.as_py() or ""
        out.append(any(map(str.isalpha, t)))  # stops at the first
    return np.array(out, bool)


def result_names(docs: DataFrame) -> list[str]:
    """Names for the columns that ``tag`` adds; with more underscores where ``docs`` has them already."""
    out, taken = [], {c.lower() for c in docs.columns}
    for name in ("_lang_pred", "_score", "_rejected"):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def tag(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, list[list[tuple[float, float]]]], text_col: str = "text", *, reject_distance: float = 0.97) -> DataFrame:
    """``docs`` with (_lang_pred, _score, _rejected), by the names of ``result_names``."""
    langs, centroids, idf, low = model
    results = result_names(docs)
    names, schema = docs.columns, docs.schema
    where = names.index(text_col)
    full = T.StructType([*schema.fields, *(T.StructField(c, t) for c, t in zip(results, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).cast(pa.string())
            best, cosine, least = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if langs:
                for a, tf in counts(texts):
                    near = vectors(tf, idf) @ centroids.T
                    best[a : a + len(tf)], cosine[a : a + len(tf)] = near.argmax(1), near.max(1)
                    least[a : a + len(tf)] = least_cosines(low, best[a : a + len(tf)], tf.sum(1))
            known = has_letter(texts) & bool(langs)
            cosine = np.where(known, np.clip(cosine, 0.0, 1.0), 0.0)
            pred = [langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(cosine), pa.array(~known | (1 - cosine > reject_distance) | (cosine < least))], [*names, *results])

    return docs.mapInArrow(run, full)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))).select("doc_id", "text", "lang")


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    return tag(docs, fit(train_rows(docs))).filter(~F.col(result_names(docs)[2])).select(*docs.columns)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tag(docs.select("doc_id", "text"), fit(train_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))
