"""Queries that write to the shared folder and read back, on a cluster that names the folder without a scheme."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from trackfold import session
from trackfold.plans import adapter, catalog
from trackfold.session import shared_dir

from tests.test_session import cluster, named  # noqa: F401

# each by the query that gives the same rows and writes nothing
TWINS = {
    "ekf_stream": "ekf_track",
    "ekf_text_stream": "ekf_track",
    "gps_seconds_files": "parse_tagged",
    "merged_files": "merge_sensors",
    "move_stream": "pose_accumulate",
    "objects_stream": "extract_objects",
    "odometry_files": "parse_tagged",
    "slam_stream": "slam_track",
    "text_stream": "parse_tagged",
    "text_files": "parse_tagged",
    "track_csv_roundtrip": "ekf_track",
    "track_landmark_files": "landmark_cloud",
    "track_parquet_roundtrip": "ekf_track",
    "track_steps_roundtrip": "ekf_track",
}
KINDS = {"gps_seconds_files": "kind = 'gps'", "odometry_files": "kind = 'odo'"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """30 events of three vehicles, some of no kind, and eight scans."""
    folder, kinds = tmp_path_factory.mktemp("tables"), ("click", "purchase", "view", "error", "signup")
    events = [(n, datetime(2024, 1, 1) + timedelta(seconds=200 * n), n % 3, kinds[n % 5], 10.0 + 7 * n) for n in range(30)]
    scans = [(n, [0.02 + 0.01 * (k * (n + 3) % 5) + 0.1 * (k // 8) for k in range(32)]) for n in range(8)]
    spark.createDataFrame(events, adapter.EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(scans, adapter.EMBEDDINGS).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", TWINS)
def test_a_folder_without_scheme_holds_all_rows(cluster, tables, tmp_path, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(session, "shared_dir", lambda spark: shared_dir(named(spark, f"{tmp_path}/kept")))
    got = catalog.QUERIES[name](cluster, tables)
    want = catalog.QUERIES[TWINS[name]](cluster, tables).filter(KINDS.get(name, "true"))
    both = [c for c in want.columns if c in got.columns]
    rows = sorted(map(str, got.select(both).collect()))
    assert rows == sorted(map(str, want.select(both).collect()))
    assert rows and list((tmp_path / "kept").iterdir())
