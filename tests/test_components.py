"""Components: any delimiter characters, numbers that keep runs together."""

import re

import pytest
from pyspark.sql import functions as F

from strandex.operators import matching, mining
from strandex.sources import lines as sources


@pytest.mark.parametrize("delimiters", ["d", "n", "ls", ".", "]", "[^-&", "\\", "-az", "&&"])
def test_any_character_splits_as_itself(spark, delimiters):
    texts = ["abd12cd3", "l\\ine [x]^y-z&&w", "plain", "d", "a-b.c/d"]
    found = sources.components(spark.createDataFrame(list(enumerate(texts)), "line_no long, line string"), delimiters)
    want = {(i, p, t) for i, text in enumerate(texts) for p, t in enumerate(x for x in re.split("[" + "".join(map(re.escape, delimiters)) + "]", text) if x)}
    assert {tuple(r) for r in found.collect()} == want


def test_a_frequent_component_takes_one_window_for_each_run_of_lines(spark):
    lines = spark.range(300).select(F.col("id").alias("line_no"), F.lit("abc/abc").alias("line"))
    mined = sources.numbered_components(lines, "/")
    run = 100 << sources.COMPONENT_BITS
    grams = mining.kgrams(mined, 3)
    assert grams.select(F.floor(F.col("line_no") / run).alias("run")).distinct().count() == 3
    counted = [r["hh"] for r in mining.running_counts(grams, run).orderBy("line_no").collect()]
    assert counted == [0, *range(2, 601)]


def test_long_patterns_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 3)
    lines = spark.createDataFrame([(0, "abcd")], "line_no long, line string")
    found = matching.occurrences(lines, spark.createDataFrame([(1, "abc"), (2, "cd")], "symbol int, str string"))
    assert {tuple(r) for r in found.collect()} == {(0, 3, 3, 1), (0, 4, 2, 2)}
