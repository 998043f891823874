"""Every registered query against its SQL, on the smallest tables."""
import os

import pytest

from oracle import compare, duck
from screenloom.plans.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("SCREENLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Fits need more groups than the smallest tables have."""
    assert QUERIES[name](spark, FOLDER.replace("sf0.001", "sf0.01")).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
