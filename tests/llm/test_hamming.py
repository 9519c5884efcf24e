"""SimHash by multi-index hashing against a plain version over all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from trackfold.llm import hamming_tables, queries


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """``(id, hex, smallest id reachable)`` of ``(id, fingerprint)``, by all pairs."""
    prints = sorted({p for _, p in pairs})
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, p in pairs:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, f"{p:016x}", least.get(find(p))) for i, p in pairs)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_whole_table(spark, sf_dir, texts):
    got = rows_of(queries.QUERIES["op12_hamming_tables"](spark, sf_dir))
    assert got == plain_components([(i, plain_print(t)) for i, t in texts.items()])
    assert sum(n for (i, _, c), n in got.items() if i != c) > 5


@pytest.mark.parametrize("crowd", [64, 0])
def test_odd_rows(odd, empty, crowd):
    got = rows_of(hamming_tables.similar_prints(odd, crowd=crowd))
    assert got == plain_components([(i, plain_print(t)) for i, t, _, _ in TEXTS])
    assert hamming_tables.similar_prints(empty, crowd=crowd).count() == 0


def test_spark_has_the_same_hash(spark):
    text = "one two three"
    want = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert hamming_tables.shingle_hashes(text.encode()).view(np.int64).tolist() == [want]


def made_prints(seed, centres, around, weak):
    """Fingerprints in clusters that differ from their centre in some of ``weak`` bits."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(centres):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        bits = rng.choice(64, weak, replace=False).tolist()
        for _ in range(around):
            out.add(centre ^ sum(1 << b for b in bits if rng.random() < 0.4))
    return sorted(out)


@pytest.mark.parametrize("crowd", [0, 2, 8, 10_000])
@pytest.mark.parametrize("weak", [6, 14])
def test_links_do_not_hang_on_crowding(spark, crowd, weak):
    prints = made_prints(weak, 12, 40, weak)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p, i, 1) for i, p in enumerate(signed)], "print long, id long, copies long")
    links = [(a % 2**64, b % 2**64) for a, b in map(tuple, hamming_tables.linked_prints(table, crowd).collect())]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[find(a)] = find(b)
    number = {p: i for i, p in enumerate(prints)}
    want = {i: c for i, _, c in plain_components([(number[p], p) for p in prints])}
    least = {}
    for p in prints:
        least[find(p)] = min(number[p], least.get(find(p), number[p]))
    assert {number[p]: least[find(p)] for p in prints} == want
    assert len(set(want.values())) < len(prints)


def test_many_rows_of_one_print(spark, monkeypatch):
    monkeypatch.setattr(hamming_tables, "MOST_FREQUENT", 3)
    monkeypatch.setattr(hamming_tables, "FREQUENT", 5)
    docs = spark.createDataFrame(
        [(i, "the same few words here" if i % 3 == 0 else f"text {i} of {i * 7} other {i * i}") for i in range(60)],
        "doc_id long, text string")
    got = rows_of(hamming_tables.similar_prints(docs))
    assert got == plain_components([(r["doc_id"], plain_print(r["text"])) for r in docs.collect()])
