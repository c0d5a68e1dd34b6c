"""Plans: pruned scans, pushed filters, no Cartesian products, no Python where columns suffice."""

import re

import pytest
from oracle import DATA

from corpusloom.plans import QUERIES

#: Queries that join a one-row aggregate or two small key spines.
ONE_ROW = {"b11_missing_combinations", "c1_label_counts", "c13_token_summary", "i20_fingerprints", "r1_describe", "c9_overall_metrics", "c18_run_timing", "d4_winsorize_all", "e2_nearest_centroid", "e7_hashed_centroids", "x3_first_seen"}
PYTHON = {"a3_norm_ids", "f3_page_breaks", "i14_docx"}  # page repair, document files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    if name == "f2_fe_ols":
        return  # its result is a small table made from collected moments
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert ("BroadcastNestedLoopJoin" in text) <= (name in ONE_ROW)
    assert bool(re.search("ArrowEvalPython|MapInArrow|BatchEvalPython|MapInPandas", text)) == (name in PYTHON)


@pytest.mark.parametrize("name,columns", [("c6_value_counts", "l_returnflag:string"), ("b5_keep_last", "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz"), ("c13_token_summary", "n_chars:bigint")])
def test_scans_read_only_what_is_needed(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, DATA)))
    assert set(schemas) == {columns}


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["b11_missing_combinations"](spark, DATA))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(c_acctbal,9000", text)


def test_results_do_not_depend_on_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = {name: sorted(map(str, QUERIES[name](spark, DATA).collect())) for name in ("a11_entity_counts", "d7_select_batch", "a10_merge_fragments")}
            seen.add(str(rows))
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
