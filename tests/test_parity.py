"""Named queries against their SQL twins.

By default one representative of every family runs at the smallest scale;
PARITY=all runs every query, PARITY_DIR picks the data folder.
"""

import os

import pytest

import __spark_entry__ as entry
from harness import compare, connect

DIR = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "A5_json_records", "A13_upsert_last_wins", "B4_id_span_flag", "C6_double_anti_join", "C12_within_distance", "D6_table_fingerprint",
    "D17_conflict_fold_prefer", "E9_greedy_chunks", "E15_holm", "F5_resolution_marking", "G8_name_variants", "G18_latest_year",
    "H5_term_label_q_values", "I10_kruskal_wallis", "J8_pagerank", "J25_shared_patterns", "K14_safe_replacements", "L7_item_status",
]
NAMES = sorted(ORACLES) if os.environ.get("PARITY") == "all" else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problems = compare(QUERIES[name](spark, DIR), con, ORACLES[name])
    assert [p for p in problems if p != "EMPTY"] == []


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
