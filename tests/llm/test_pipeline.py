"""The pipeline's stages one by one, each judged on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import TEXTS
from tests.llm.test_text_models import PIECES, expected_components
from trackfold.llm import divergence_rules
from trackfold.llm.base import documents as table
from trackfold.session import cut


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into and comes out of every stage."""
    docs, out = table(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return [r[0] for r in df.select("doc_id").collect()]


def test_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name


def test_quality_stage(stages):
    _, before, after = stages[0]
    kept = divergence_rules.quality(before).filter("kept")
    assert sorted(ids(after)) == sorted(ids(kept))


def test_exact_stage(stages):
    _, before, after = stages[1]
    best = {}
    for r in before.collect():
        key = r["text"].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert sorted(ids(after)) == sorted(best.values())


def test_near_stage(stages):
    _, before, after = stages[2]
    pairs = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = [i for (i, n, c) in expected_components(pairs, 5, 80) if not n or c == i]
    assert sorted(ids(after)) == sorted(want)


def test_mix_stage(stages):
    _, before, after = stages[3]
    rows = {r["doc_id"]: r for r in before.collect()}
    times = Counter(ids(after))
    assert set(times) <= set(rows) and max(times.values()) <= 3
    words = lambda i: len(rows[i]["text"].split())
    total = sum(map(words, rows))
    assert abs(sum(words(i) * n for i, n in times.items()) - total) <= 0.1 * total


def test_piece_stage(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    _, before, after = stages[4]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == texts[r["doc_id"]]
        assert r["ids"] == library.encode(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_run(spark, sf_dir, stages):
    assert Counter(ids(corpus_pipeline.run(spark, sf_dir))) == Counter(ids(stages[-1][2]))


def test_stages_take_odd_and_empty_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            if name != "to_pieces":
                assert after.columns == docs.columns
            assert after.count() <= 3 * len(TEXTS)
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.quality_rules(spark, blank, sf_dir).count() == 0
    assert corpus_pipeline.near_dedup(spark, blank, sf_dir).count() == len(TEXTS)
