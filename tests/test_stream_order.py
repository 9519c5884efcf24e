"""Registered stream queries over several files, in and out of time order, each file a micro-batch."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackfold.plans import adapter, catalog


@pytest.fixture(scope="module")
def cut_up(spark, sf_dir, tmp_path_factory):
    """A few vehicles: the tables in one file each, and in four files in and out of order of time."""
    root = tmp_path_factory.mktemp("sf")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id < 5")
    scans = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 20")
    for name, df, time in (("events", events, "ts"), ("embeddings", scans, "vec_id % 4")):
        df = df.selectExpr("*", f"ntile(4) OVER (ORDER BY {time}) AS _n")
        df.drop("_n").coalesce(1).write.parquet(f"{root}/whole/{name}.parquet")
        for kind, order in (("ordered", (1, 2, 3, 4)), ("mixed", (3, 1, 4, 2))):
            for n in order:
                df.filter(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(f"{root}/{kind}/{name}.parquet")
    return root


@pytest.mark.parametrize("query, kind", [
    ("ekf_stream", "ordered"), ("move_stream", "mixed"), ("objects_stream", "mixed"), ("discrete_stream", "mixed"),
    ("ekf_stream", "mixed"), ("slam_stream", "mixed")])
def test_order_of_files_does_not_matter(spark, cut_up, monkeypatch, query, kind):
    want = catalog.QUERIES[query](spark, f"{cut_up}/whole").collect()
    monkeypatch.setattr(adapter, "MICRO_BATCH", 1)
    got = catalog.QUERIES[query](spark, f"{cut_up}/{kind}").collect()
    assert want and Counter(map(str, got)) == Counter(map(str, want))
