"""Mining against a sequential scan written from the definitions, and invariants."""

import random
from collections import Counter

import pytest

from strandex import schema
from strandex.operators import mining

CORPUS = ["http://www.abc.com/", "http://www.abd.com/x", "aaaaaa", "ab", "abc", "abcd", "http://www.abc.com/", "xyzxyzxyz", "//", "he she hers", "aXbXc" * 3]


@pytest.fixture(scope="module")
def corpora():
    r = random.Random(1)
    return [CORPUS, ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(80)], ["".join(r.choice(["http://", "www.", "ab", "xy", ".com", "/"]) for _ in range(r.randint(1, 6))) for _ in range(60)]]


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), schema.LINES)


def scan(lines, k, ratio, trim=True):
    """Series of each line, found by one pass over the stream of k-grams."""
    seen, out = Counter(), set()
    for no, line in enumerate(lines):
        run, previous = None, 0
        last = len(line) - k
        for i in range(last + 1):
            gram = line[i : i + k]
            seen[gram] += 1
            heavy = seen[gram] if seen[gram] > 1 else 0
            joined = heavy and previous and heavy < previous / ratio and heavy > ratio * previous
            if run and not joined:
                out.add((no, run[0], run[1], line[run[0] : run[1] + k]))
                run = None
            if heavy:
                if run:
                    run[1] = i
                elif trim and i == last and previous and not joined:
                    pass
                else:
                    run = [i, i]
            previous = heavy
        if run:
            short = trim and run[1] > run[0]
            out.add((no, run[0], run[1], line[run[0] : run[1] + k - short]))
    return out


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("ratio", [0.5, 0.9])
@pytest.mark.parametrize("trim", [True, False])
def test_series(spark, corpora, k, ratio, trim):
    for lines in corpora:
        df = frame(spark, lines)
        for run in (3, 1 << 16):
            found = {tuple(r) for r in mining.series(mining.running_counts(mining.kgrams(df, k), run), df, k, ratio, trim).collect()}
            assert found == scan(lines, k, ratio, trim)


def test_scores_and_candidates(spark):
    counts = [("he", 5), ("she", 3), ("hers", 2), ("x", 4), ("shehe", 1)]
    df = spark.createDataFrame(counts, "pat string, real_count long")
    want = {(p, n, 1 + sum(m for q, m in counts if p in q)) for p, n in counts}
    assert {tuple(r) for r in mining.containment_scores(df).collect()} == want
    best = [r["pat"] for r in mining.top_candidates(mining.containment_scores(df), 3).collect()]
    assert best[0] == "he" and mining.top_candidates(mining.containment_scores(df), 0).count() == 0
    assert mining.pool_size(100) == 1120 and mining.pool_size(1000) == 1200


def test_scores_start_no_job_of_their_own(spark):
    df = spark.createDataFrame([("he", 5), ("she", 3)], "pat string, real_count long")
    spark.sparkContext.setJobGroup("scores", "scores")
    scored = mining.containment_scores(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("scores")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in scored.collect()} == {("he", 5, 9), ("she", 3, 4)} and mining.containment_scores(df.limit(0)).count() == 0


def test_white_list(spark):
    series = spark.createDataFrame([(1, 0, 0, "abc"), (1, 2, 3, "zzz"), (2, 0, 1, "ab")], schema.SERIES)
    listed = spark.createDataFrame([("xabcx",), ("q",)], "pat string")
    assert {r["text"] for r in mining.without_listed(series, listed, 3).collect()} == {"zzz", "ab"}


def test_histogram(spark):
    found = {r["symbol"]: r["freq"] for r in mining.histogram(frame(spark, ["aab", "~ ", ""])).collect()}
    assert len(found) == 127 and found[97] == 3 and found[98] == 2 and found[126] == 2 and found[32] == 2 and found[1] == 1


def test_space_saving_bounds(spark):
    r = random.Random(3)
    items = [r.choice("aaaaabbbccdefghijklmnop") for _ in range(900)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i long, x string")
    true, capacity = Counter(items), 8
    found = mining.space_saving(df, "x", ["i"], capacity).collect()
    assert len(found) == capacity and sum(f["count"] for f in found) == len(items)
    for f in found:
        assert true[f["item"]] <= f["count"] <= true[f["item"]] + len(items) // capacity and f["count"] - f["delta"] <= true[f["item"]]


def test_approximate_top_finds_the_first(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 20 + [("c",)], "kgram string")
    assert [r["item"] for r in mining.approximate_top(df, "kgram", 2).collect()] == ["a", "b"]
