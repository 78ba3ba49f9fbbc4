"""Registered queries against their SQL on the smallest tables; the rest of the registry."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from compare import differences
from treeweave.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Queries that do not give a row per document.
OTHER_ROWS = {"op11_collocations", "op13_chat_format"}
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "op1_language", "op6_toxicity", "op7_quality_rules", "op8_quality_model", "op10_main_text"
    }


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, engine, name):
    rows, problem = differences(spark, engine, SF_DIR, QUERIES[name], ORACLES[name])
    assert not problem
    assert rows == 200 if name not in OTHER_ROWS else rows > 0
