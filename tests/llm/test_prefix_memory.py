"""What a worker of the similarity join holds at a time, however large Spark's batches are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from trackfold.llm import prefix_join


class Maps:
    """In the place of a table: keeps the Arrow maps it is given."""

    def __init__(self, spark):
        self.sparkSession, self.maps = spark, []

    def select(self, *columns):
        return self

    repartition = join = filter = distinct = select

    def mapInArrow(self, fn, ddl):
        self.maps.append(fn)
        return self

    def collect(self):
        return []


def test_texts_are_handled_in_slices(spark):
    text = " ".join(f"word{n}" for n in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([text] * 5000)], names=["doc_id", "text"])
    docs = Maps(spark)
    prefix_join.texts_with_prefixes(docs, np.zeros(1 << 10, np.uint32), 5, 80, "doc_id", "text")
    out = list(docs.maps[0](iter([batch])))
    assert sum(b.num_rows for b in out) == 5000
    assert max(b.num_rows for b in out) * len(text) < 3 << 20


def test_pairs_are_compared_in_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "cut", lambda df, *by: df)
    monkeypatch.setattr(prefix_join, "bounded", lambda df, rows: df)
    docs = Maps(spark)
    prefix_join._compare(docs, docs, 5, 80, "doc_id", "text")
    sets, linked = docs.maps
    text = " ".join(f"word{n}" for n in range(400))
    out = list(sets(iter([pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([text] * 5000)], names=["id", "text"])])))
    assert sum(b.num_rows for b in out) == 5000 and max(b.num_rows for b in out) * len(text) < 3 << 20
    one, other = np.arange(400, dtype=np.uint64).tobytes(), np.arange(100, 500, dtype=np.uint64).tobytes()
    pairs = pa.RecordBatch.from_arrays(
        [pa.array(range(4000)), pa.array(range(4000, 8000)), pa.array([one] * 4000), pa.array([one, other] * 2000)],
        names=["a", "b", "held_a", "held_b"])
    out = list(linked(iter([pairs])))
    assert len(out) > 3 and [a for b in out for a in b.column(0).to_pylist()] == list(range(0, 4000, 2))


def test_words_kept_are_few():
    hashes = prefix_join.WordHashes()
    for n in range(100_000):
        hashes[b"word%d" % n]
    assert len(hashes) <= 1 << 16
    assert hashes[b"word5"] == prefix_join.WordHashes()[b"word5"]
