"""Language of a text by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes a blank, and its 1- to 3-character n-grams
are counted in ``DIMENSIONS`` hashed places. Vectors are ``(1 + ln tf) * idf`` at length one.
Document frequencies are counted over all training rows. Centroids are fitted on at most
``SAMPLE`` training rows per language (those with the smallest hash of id and text), one language
a task: spherical k-means from a farthest-first start. A text gets the language of the centroid
with the largest cosine. A centroid's reach is the cosine that all but ``OUTSIDE`` of its members
have; a text farther from its centroid than that is ``rejected`` (the nearest language is named
all the same, so that callers choose what a rejection means).

Of the values of the label, the ``LANGUAGES`` with the most training rows are learned
(ties: first by name), so that a dirty label column ends no job; texts of the others are predicted
like any. Only text and label of training rows are learned from. A null text, or one without letters, is ``und`` with score 0, as
is every text if nothing could be learned (no labelled training row with letters, empty table).
Languages with few rows have fewer centroids; ties go to the language first by name. Rows that
repeat are predicted each. A null id is a training row. Columns beyond these are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import bounded
from trackfold.session import cut

DIMENSIONS = 1 << 12
SAMPLE = 1500
CENTROIDS = 4
STEPS = 8
OUTSIDE = 0.005
LANGUAGES = 500
SALTS = 256
SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None for a text without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    # one blank for what stands between words, one at either end
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    mixed = codes * SPREAD[0]
    mixed ^= mixed >> np.uint32(15)
    for n in range(3):
        if n:
            mixed = (mixed[:-1] + codes[n:]) * SPREAD[n]
            mixed ^= mixed >> np.uint32(15)
        total += np.bincount(mixed & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return total


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One or more rows of counts as vectors of length one."""
    out = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    length = np.sqrt((out * out).sum(axis=-1, keepdims=True))
    return (out / np.maximum(length, 1e-12)).astype(np.float32)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts of the one column given each place occurs; the last entry counts texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in texts.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def k_means(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and which one each vector is nearest to."""
    start = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[start[0]]
    while len(start) < min(k, len(vectors)) and near.min() < 1 - 1e-6:
        start.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[start[-1]])
    centers = vectors[start]
    for _ in range(STEPS):
        of = np.argmax(vectors @ centers.T, axis=1)
        sums = np.stack([vectors[of == c].sum(axis=0) if (of == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centers.astype(np.float32), np.argmax(vectors @ centers.T, axis=1)


def chosen_rows(rows: DataFrame, sample: int, languages: int) -> DataFrame:
    """``_lang, _hash`` of the training rows to fit centroids on: the smallest hashes of each learned label.

    No label is sorted as a whole: ranks are taken within salts of a label first, and what is left
    of all salts, ``SALTS`` times the sample at most, is ranked once more.
    """
    hashed = rows.select("lang", F.xxhash64("doc_id", "text").alias("hash")).distinct()
    learned = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    hashed = hashed.join(F.broadcast(learned), "lang", "left_semi").withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    for keys in (("lang", "salt"), ("lang",)):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        hashed = hashed.withColumn("n", nth).filter(F.col("n") <= sample).drop("n")
    return hashed.select(F.col("lang").alias("_lang"), F.col("hash").alias("_hash"))


def fit(
    rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES,
) -> tuple[np.ndarray, pd.DataFrame]:
    """Weights of places, and centroids (``lang, center, reach``), from ``doc_id, text, lang``."""
    frequencies = document_frequencies(rows.select("text"))
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    # the sample is chosen by hashes; texts are fetched for the chosen only
    chosen = cut(chosen_rows(rows, sample, languages))
    wanted = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    wanted = wanted.join(bounded(chosen), (F.col("lang") == F.col("_lang")) & (F.col("hash") == F.col("_hash")))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("hash").sort_values("hash")
        counts = [c for c in map(ngram_counts, part["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "center": [], "reach": []})
        vectors = weigh(np.stack(counts), idf)
        centers, of = k_means(vectors, centroids)
        near = (vectors * centers[of]).sum(axis=1)
        reach = [float(np.quantile(near[of == c], OUTSIDE)) if (of == c).any() else 0.0 for c in range(len(centers))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "center": [c.tobytes() for c in centers], "reach": reach})

    fitted = wanted.select("lang", "text", "hash").groupBy("lang").applyInPandas(learn, "lang string, center binary, reach double")
    return idf, fitted.toPandas().sort_values("lang", kind="stable").reset_index(drop=True)


def predict(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES,
) -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score, rejected``; learns from rows not held out."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    idf, found = fit(rows.filter("not held_out and lang is not null").select("doc_id", "text", "lang"), sample, centroids, languages)
    names, reach = found["lang"].tolist(), found["reach"].to_numpy()
    centers = np.stack([np.frombuffer(c, np.float32) for c in found["center"]]) if names else np.zeros((0, DIMENSIONS))
    shared = docs.sparkSession.sparkContext.broadcast((idf, names, reach, centers))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, names, reach, centers = shared.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                counts = ngram_counts(text) if names else None
                if counts is None:
                    out.append(("und", 0.0, True))
                    continue
                near = centers @ weigh(counts, idf)
                best = int(np.argmax(near))
                out.append((names[best], float(np.clip(near[best], 0, 1)), bool(near[best] < reach[best])))
            if out:
                lang, score, rejected = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        name, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
