"""Registered queries against their SQL; ``ORACLE_ALL=1`` runs every one."""

import os

import oracle
import pytest

from codegraph_spark.workloads import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "explode_lines", "parse_diagnostics", "extract_symbols", "lexical_usages", "symbols_by_name", "resolve_path", "fuzzy_compact", "snippet_search",
    "regex_scan", "impact_expand", "graph_query", "replace_plan", "history", "latency_stats", "category_counts",
    "scan_files", "expand_imports", "link_lexical_all", "semantic_search", "pack_compact", "callers_of", "callers_by_name", "callees_of", "compact_graph", "rename_plan",
    "patch_files", "edit_lines", "read_range", "read_spans", "read_many", "source_context", "deps", "commit_summary", "file_facts", "kind_and_path_filter", "test_map",
    "compare_workflows", "stream_telemetry", "implements_names", "extract_symbols_braces", "dict_encode_graph", "merge_base", "rename_chain",
    "regex_scan_indexed", "rg_search_all",
]
NAMES = sorted(QUERIES) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.difference(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 120
