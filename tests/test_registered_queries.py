"""Registered queries against their SQL on the smallest tables, and plan checks."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "P1_remove_null_rows", "P8c_find_by_patterns", "F1_combine_text", "F6_dietary_combinations", "F8_query_filters", "A1_value_counts",
    "A5_run_audit", "A9_histogram", "A18_cluster_summary", "W1_first_per_key", "W2_stratified_split", "T2_seeded_window", "J2_left_join_two_keys",
    "J1_annotation_view", "P7_drop_trivial_matches", "M6_delete_stats", "M14_edit_outcomes", "D-5_stats", "L1_build_prompts",
    "L4_flatten_with_dimensions", "L8_flatten_results", "M17_run_summary", "V6_top_k", "V9_hit_rate", "S1_read_csv",
]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@needs_data
@pytest.mark.parametrize("key", QUICK)
def test_same_rows_as_sql(spark, con, key):
    df = entry.queries()[key](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_is_prefixed_by_its_operator():
    assert all(k.split("_")[0] for k in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("key", ["A1_value_counts", "J1_bulk_view", "F6_dietary_combinations", "M6_delete_consumables", "W1_first_per_key", "V6_top_k", "W2_stratified_split"])
def test_plans_have_no_products_and_no_row_functions(spark, key):
    plan = entry.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
