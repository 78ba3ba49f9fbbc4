"""Every registered query against its check text on the smallest tables."""

import pathlib

import pytest

import __spark_entry__ as entry
from compare import check_engine, differences
from treeweave.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="tables not present")

@pytest.fixture(scope="module")
def engine():
    return check_engine(SF_DIR)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    rows, problem = differences(spark, engine, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert not problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
