"""Plans: columns pruned at the scan, filters pushed down, no Python in the base queries, no product."""

import re

import pytest

from hashloom import catalogue

PYTHON = {"split_fastcdc", "split_repmaxcdc", "compression_round_trip", "digest_functions_exotic"}
LITERAL = {"capabilities"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith("stream_")))
def test_no_python_and_no_product(spark, data, name):
    text = plan(catalogue.QUERIES[name](spark, data))
    if name not in PYTHON:
        assert not re.search("Python|Pandas|InArrow", text)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize(("name", "columns"), [("digest_of", "doc_id:bigint,text:string"), ("resolve_two_hop", "l_orderkey:bigint,l_linenumber:int"), ("ac_upsert_lww", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double"), ("cpu_quota", "p_partkey:bigint,p_size:int")])
def test_scans_read_what_they_need(spark, data, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(catalogue.QUERIES[name](spark, data))


def test_filters_reach_the_scan(spark, data):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan(catalogue.QUERIES["first_terminal"](spark, data))


def test_aggregates_combine_before_the_shuffle(spark, data):
    for name in ("dedup_content", "ac_upsert_lww", "digest_shape", "median_upper"):
        assert "partial_" in plan(catalogue.QUERIES[name](spark, data))
