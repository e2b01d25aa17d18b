"""Registered queries against DuckDB on the smallest test tables, and the parts
of the contract that need no data."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
OWN = set(QUERIES) - set(contract.LLM_QUERIES)
SAMPLE = (
    "listing_columns",
    "parse_filename",
    "filename_error",
    "format_name",
    "update",
    "validate_assets",
    "asset_summary",
    "asset_metadata",
    "export_folders",
    "missing_coordinates",
    "missing_values",
    "graph_edges",
    "image_traits",
    "rule_homogenous",
    "rule_coordinate",
    "search_frame_gaps",
    "search_group_concat",
    "progress_latest",
    "catalog_update",
    "catalog_changes",
    "search_recursive",
)


def test_every_query_has_its_sql():
    assert OWN <= set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR, QUERIES, ORACLE) == ""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_the_scan_reads_three_columns(spark):
    plan = QUERIES["asset_summary"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
