from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("size", T.StringType()),
    T.StructField("row", T.StringType()),
    T.StructField("kept", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("ids", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("shard", T.StringType()),
    T.StructField("_id", T.StringType()),
    T.StructField("_mark", T.StringType()),
])

LONG = " ".join(f"word{n % 977} of{n % 31} text{n}" for n in range(4000))
PASSAGE = ("The river ran past the old mill and the children used to play there in summer. Nobody owned the mill, "
           "although three families claimed it. When the war came, the wheel was taken for its iron. After that "
           "the water kept its own time, and the children grew up and moved to the town on the hill.")
EN = "the cat and the dog of the house were in the garden for the whole of the day and that was that"
DE = "der hund und die katze aus dem haus waren den ganzen tag im garten und das war auch schon alles"

TEXTS = [
    (1, f"{EN}. {PASSAGE} {EN}", "en", "a"),
    (2, f"{EN.upper()}. {PASSAGE.upper()} {EN.upper()}", "en", "a"),
    (3, f"{DE} und dann kam noch dieses hier dazu: {PASSAGE} so war es", "de", "b"),
    (4, DE, "de", "b"),
    (5, DE, "de", "c"),
    (6, "", "en", "c"),
    (7, None, None, None),
    (8, " \t\n ", "de", None),
    (9, "one", "en", "a"),
    (10, "one  two", "en", "a"),
    (11, "ONE\ttwo", "en", "b"),
    (12, LONG, "en", "c"),
    (13, LONG + " more", "en", "c"),
    (14, "### $$$ *** %%% " * 40, "en", "a"),
    (15, "same line here\n" * 30, "en", "b"),
    (16, "é à ü ß ñ 中文 \U0001f600 ▁ x", "fr", "b"),
    (None, EN, "en", "a"),
    (None, DE, None, "b"),
    (17, " ".join(f"{EN} {n}" for n in range(12)), "en", "a"),
    (18, " ".join(f"{DE} {n}" for n in range(12)), "de", "b"),
    (4, DE, "de", "b"),
    (4, DE, "de", "b"),
]


def rows(texts):
    return [(i, t, lang, source, None if t is None else len(t), *["clash"] * 10) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, copies, repeated ids, long texts, and columns with names used inside."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """The test documents as a dict from id to text."""
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
