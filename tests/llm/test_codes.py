"""Vector codes by bitmask slices against a plain version, and the search alone against all entries."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackfold.llm import bitmask_codes
from trackfold.llm.bitmask_codes import Slices

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, part int"


def plain(vectors, parts=4, entries=256, rounds=4):
    """``{(id, code, error, label error): times}`` and the hash of the codebooks, by loops over all entries."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], label) for i, v, label in vectors
            if v and len(v) % parts == 0 and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return Counter(), None
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(part(v, p), book)[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(members[n]) for c in zip(*members[n])] if n in members else e
                        for n, e in enumerate(book)]
    rows, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(part(v, p), books[p]) for p in range(parts)]
        rows.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
        by_label[label] += rows[-1][2]
    joined = ",".join(str(c) for b in books for e in b for c in e)
    return Counter((i, c, e, by_label[label]) for i, c, e, label in rows), hashlib.sha256(joined.encode()).hexdigest()


def checked(spark, vectors, **rules):
    table = spark.createDataFrame([(*v, "c", 1, 2) for v in vectors], SCHEMA).repartition(3)
    got = bitmask_codes.compressed(table, **rules).collect()
    want, sha = plain(vectors, **rules)
    assert Counter(tuple(r)[:4] for r in got) == want
    assert {r["codebooks_sha256"] for r in got} <= {sha}
    return got


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 0.1, 8).tolist(), i % 3 or None) for i in range(40)]
    vectors += [(3, vectors[3][1], 1), (3, vectors[4][1], None), (None, vectors[5][1], 2), (None, None, 1), (90, [], 1),
                (91, [0.1] * 7 + [None], 1), (92, [0.1] * 7 + [float("nan")], 1), (93, [float("inf")] + [0.1] * 7, 1),
                (94, [0.1] * 4, 1), (95, [0.1] * 7, 1), (96, [-0.0] * 8, None), (97, [900.0, -900.0] * 4, 3)]
    assert len(checked(spark, vectors, entries=16)) == 45
    assert len(checked(spark, vectors)) == 45
    assert len(checked(spark, [(1, None, 1), (2, [], None)])) == 0
    assert len(checked(spark, [])) == 0
    assert len(checked(spark, [(5, [0.25] * 4, None)])) == 1


def test_many_ties_and_few_values(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), 7) for i in range(150)]
    checked(spark, vectors, entries=32)


def test_values_beyond_the_largest_are_set_to_it(spark):
    table = spark.createDataFrame([(1, [3e38, -3e38, 1e9, 0.0], 1, "", 1, 1), (2, [0.0] * 4, 1, "", 1, 1)], SCHEMA)
    assert {r["error"] for r in bitmask_codes.compressed(table).collect()} == {0}
    x = bitmask_codes.integers(table, "vec_id", "embedding", "label", 4).orderBy("vec_id").first()["x"]
    assert x == [bitmask_codes.LARGEST, -bitmask_codes.LARGEST, bitmask_codes.LARGEST, 0]


def test_codes_stand_for_near_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = bitmask_codes.integers(vectors, "vec_id", "embedding", "label", 4)
    books = bitmask_codes.train(table)
    codes = bitmask_codes.encode(table, books)
    back = {r["vec_id"]: np.array(r["vector"]) for r in bitmask_codes.decode(codes, books).collect()}
    error = {r["vec_id"]: r["error"] for r in codes.collect()}
    for r in vectors.collect():
        whole = np.floor(1024 * np.array(r["embedding"], float))
        assert ((whole - 1024 * back[r["vec_id"]]) ** 2).sum() == pytest.approx(error[r["vec_id"]])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 64, 65, 200, 256, 300]), st.sampled_from([1, 2, 16]),
       st.sampled_from([2, 300, 10**7]), st.sampled_from([1, 7, 500, 10**6]))
def test_search_finds_the_nearest_for_any_radius(seed, entries, width, spread, radius):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread, (entries, width))
    parts = rng.integers(-spread, spread, (60, width))
    best, square = Slices(book).nearest(parts, radius)
    all_ = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (square == all_.min(1)).all()
