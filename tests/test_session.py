"""The shared folder, for local sessions and clusters."""

from __future__ import annotations

import warnings
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter

from trackfold import session
from trackfold.plans import catalog
from trackfold.session import shared_dir, shared_folder


def named(spark, folder: str | None):
    """The session with ``folder`` for its ``spark.checkpoint.dir``."""
    return SimpleNamespace(sparkContext=spark.sparkContext, conf=SimpleNamespace(get=lambda key, default: folder or default))


@pytest.fixture
def cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


def test_a_folder_without_scheme_is_one_of_the_default_file_system(cluster, tmp_path):
    assert shared_dir(named(cluster, f"{tmp_path}/")) == f"file:{tmp_path}"
    hadoop = cluster.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    hadoop.set("fs.defaultFS", "viewfs://store/")
    try:
        assert shared_dir(named(cluster, "/in/kept")) == "viewfs://store/in/kept"
    finally:
        hadoop.set("fs.defaultFS", before)


def test_a_folder_with_its_scheme_stays_as_it_is(cluster, tmp_path):
    assert shared_dir(named(cluster, f"file:{tmp_path}")) == f"file:{tmp_path}"


def test_a_cluster_without_any_folder_is_refused(cluster):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))


def test_a_local_folder_needs_no_scheme(spark, tmp_path):
    assert shared_dir(named(spark, str(tmp_path))) == str(tmp_path)


@pytest.mark.parametrize("name", ["text_files", "track_parquet_roundtrip", "move_stream"])
def test_files_and_streams_on_a_cluster(spark, sf_dir, monkeypatch, name):
    there = catalog.QUERIES[name](spark, sf_dir).count()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert catalog.QUERIES[name](spark, sf_dir).count() == there > 0


@pytest.fixture
def apart(cluster, monkeypatch, tmp_path):
    """A named folder that each machine has for itself: the driver does not find what tasks have written there."""
    folder = f"file:{tmp_path}/own"
    for name in ("parquet", "text"):
        def write(self, path, *options, to=getattr(DataFrameWriter, name), **more):
            to(self, path, *options, **more)
            if path.startswith(folder):
                for part in Path(path.removeprefix("file:")).rglob("*part-*"):
                    part.unlink()

        monkeypatch.setattr(DataFrameWriter, name, write)
    monkeypatch.setattr(session, "shared_dir", lambda spark: folder)
    return folder


@pytest.mark.parametrize("name", ["text_files", "odometry_files", "track_parquet_roundtrip"])
def test_no_row_is_lost_in_a_folder_of_one_machine(spark, sf_dir, apart, name):
    with pytest.warns(UserWarning, match="not all executors"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_a_folder_of_one_machine_is_refused_without_another(cluster, apart, tmp_path, monkeypatch):
    (tmp_path / "file").write_text("")
    unwritable = f"file:{tmp_path}/file/below"
    monkeypatch.setattr(cluster.sparkContext, "getCheckpointDir", lambda: unwritable)
    monkeypatch.setattr(cluster.conf, "get", lambda key, *default: unwritable)
    with pytest.raises(ValueError, match="every executor"):
        shared_folder(cluster)


def test_a_folder_all_reach_is_kept(cluster, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file:{tmp_path}")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert shared_folder(cluster) == f"file:{tmp_path}"
