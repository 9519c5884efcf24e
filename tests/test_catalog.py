"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from trackfold.plans import catalog, oracles
from tests.compare import difference, oracle_frame, ordered

# the fast prediction spreads rounding, so its SQL agrees to a few thousandths only
NO_SQL = {"slam_fast"}


def test_only_the_fast_prediction_lacks_sql():
    assert set(catalog.QUERIES) - set(driver.oracle_sql()) == NO_SQL
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = driver.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name not in NO_SQL:
        assert difference(got, oracle_frame(sf_dir, driver.oracle_sql()[name])) is None


def test_fast_prediction_is_near_its_sql(spark, sf_dir):
    got = ordered(driver.queries()["slam_fast"](spark, sf_dir).toPandas())
    want = ordered(oracle_frame(sf_dir, oracles.slam_track_sql(predict="fast")))
    got, want = (df.set_index(["vehicle", "t_ms", "seq", "step"]).sort_index() for df in (got, want))
    assert got.index.equals(want.index) and (got["landmarks"] == want["landmarks"]).all()
    for name in ("x", "y", "phi"):
        assert (got[name] - want[name]).abs().max() < 0.005


def test_entry(spark):
    assert driver.entry(spark).count() > 0
