"""Physical plans: no join without keys, only the columns that are needed, patterns looked up by a hash join."""

import pytest

import __spark_entry__ as entry
from strandex.plans import queries as own

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in own.queries() if not n.startswith("mined_") and n not in ("anchor_select",)])
def test_no_join_without_keys(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(own.queries()["kgrams_pages"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "html" not in text


def test_matching_is_a_hash_join(spark):
    text = plan(own.queries()["pattern_occurrences"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_encoding_moves_nothing(spark):
    text = plan(own.queries()["encode_bits"](spark, SF))
    assert "Exchange" not in text and "MapInArrow" in text


def test_a_validity_filter_is_applied_in_the_scan_stage(spark):
    text = plan(own.queries()["ingest_valid_lines"](spark, SF))
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("name", ["candidate_topn_parts", "kgram_series_parts", "series_line_counts_parts"])
def test_mining_broadcasts_nothing(spark, name):
    """A small file can have many k-grams: neither its size nor adaptive execution may bring them to the driver."""
    df = entry.queries()[name](spark, SF)
    assert "Broadcast" not in plan(df) and df.collect() and "Broadcast" not in plan(df)
