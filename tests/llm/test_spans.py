"""Span dedup against a brute force that knows words only, not the operator's pieces and runs."""

from __future__ import annotations

import random

import pytest

from trackfold.llm import span_dedup

DDL = "doc_id bigint, text string"


def prose(seed, n, stop=0.12):
    """Words that no other seed has, some of which end a sentence; in some of them a capital or a line end."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        word = f"w{seed}x{i}"
        out.append(word + "." if draw.random() < stop else word)
    return out


def repeated(words, earlier, size=50):
    """Places in ``words`` that are inside ``size`` words in a row found in ``earlier``."""
    lower = lambda ws: [w.lower() for w in ws]
    seen = {tuple(e[i:i + size]) for e in map(lower, earlier) for i in range(len(e) - size + 1)}
    own = lower(words)
    return {j for i in range(len(own) - size + 1) if tuple(own[i:i + size]) in seen for j in range(i, i + size)}


@pytest.mark.parametrize("stop", [0.0, 0.04, 0.15, 0.5])
def test_sentences_inside_a_repeated_passage_go(spark, stop):
    docs = {n: prose(n, 150, stop) for n in range(1, 31)}
    draw = random.Random(stop)
    for n in range(101, 131):
        source = docs[n - 100]
        at, size, host = draw.randrange(0, 60), draw.randrange(50, 90), prose(n, 80, stop)
        into = draw.randrange(0, 81)
        docs[n] = host[:into] + source[at:at + size] + host[into:]
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in docs.items()], DDL).repartition(4)
    left = {r["doc_id"]: set(r["text"].split()) for r in span_dedup.without_repeats(table).collect()}
    for n, words in docs.items():
        inside = repeated(words, [docs[m] for m in docs if m < n])
        low, high = (min(inside), max(inside)) if inside else (0, -1)
        stops = [i for i in sorted(inside) if words[i].endswith(".")]
        must = set(range(low + span_dedup.WINDOW, high + 1 - span_dedup.WINDOW)) & inside
        if stops:
            must |= set(range(stops[0] + 1, stops[-1] + 1))
        assert not {words[i] for i in must} & left[n]
        assert {w for i, w in enumerate(words) if i not in inside} <= left[n] | {
            w for i, w in enumerate(words) if i in inside}
        assert n > 100 or left[n] == set(words)


def test_whole_copies_come_back_empty(spark):
    texts = [prose(n, size, stop) for n, (size, stop) in enumerate(
        [(1, 0), (5, 0), (23, 0), (24, 0), (30, 0), (61, 0), (200, 0), (47, 0.2), (90, 0.05), (300, 0.3)])]
    texts.append(["same"] * 100)
    rows = [(n, " ".join(w)) for n, w in enumerate(texts)]
    rows += [(100 + n, "\n".join(w)) for n, w in enumerate(texts)]
    rows += [(200 + n, " ".join(x.upper() if i % 7 else x.title() for i, x in enumerate(w)) + " ") for n, w in enumerate(texts)]
    got = {r["doc_id"]: r for r in span_dedup.without_repeats(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[i]["text"] == text for i, text in rows if i < len(texts) - 1)
    assert [i for i, r in got.items() if i >= 100 and r["text"]] == []
    assert all(r["n_removed"] == r["n_sentences"] > 0 for i, r in got.items() if i >= 100)


@pytest.mark.parametrize("doc", [7, None])
def test_rows_that_share_only_the_id_are_documents_of_their_own(spark, doc):
    passage, one, two = " ".join(prose(1, 60)), " ".join(prose(2, 60)), " ".join(prose(3, 60))
    # the passage begins both texts of one id; the later document holds the passage and, at its place, its own text
    rows = [(doc, f"{passage}. {one}"), (doc, f"{passage}. {two}"), (doc, " ".join(prose(4, 200))), (9, f"{passage}. end")]
    got = [r["text"] for r in span_dedup.without_repeats(spark.createDataFrame(rows, DDL)).collect()]
    assert sum(passage in t for t in got) == 1
    assert sorted(sum(x in t for t in got) for x in (one, two, rows[2][1])) == [1, 1, 1]
    assert len(got) == 4 and sum(t.endswith("end") for t in got) == 1
