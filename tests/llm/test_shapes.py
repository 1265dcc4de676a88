"""Plans of the native operators hold no Python; row by row operators move nothing; texts move once at most."""

import re

import pytest

from strandex.llm import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_quality", "op8_winnowing"])
def test_native(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_byte_bpe", "op4_quality", "op6_toxicity", "op7_packing", "op10_license_scan"])
def test_nothing_moves(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_winnowing_moves_texts_once(spark):
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan(spark, "op8_winnowing"))) == 1


def test_no_join_without_keys(spark):
    for name in ("op2_substring_dedup", "op5_simhash", "op9_sharding"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
