"""All occurrences of many patterns in many strings, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More patterns, or more bytes of them, than this are joined by a shuffle of the windows instead of a broadcast.
BROADCAST_PATTERNS, BROADCAST_BYTES = 200_000, 32 << 20


def occurrences(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(line_no, end_pos, len, symbol), one row for each pattern (str, symbol) that ends at a position, overlaps included.

    Windows of the lengths that patterns have are looked up by an equi-join, so no pair of a string and a pattern that
    isn't in it is looked at. The pattern side is broadcast only up to BROADCAST_PATTERNS rows and BROADCAST_BYTES bytes.
    """
    distinct = patterns.select(F.col("str").alias("pat"), "symbol").where("pat <> ''").distinct()
    found = distinct.groupBy(F.length("pat").alias("n")).agg(F.count("*").alias("k"), F.sum(F.octet_length("pat")).alias("b")).collect()  # one row for each length
    lengths = sorted(r["n"] for r in found)
    every = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    by_length = lines.select("line_no", "line", F.explode(F.filter(every, lambda n: n <= F.length("line"))).alias("len"))
    windows = by_length.select("line_no", "len", F.explode(F.sequence(F.lit(1), F.length("line") - F.col("len") + 1)).alias("i"), "line").select("line_no", "len", (F.col("i") + F.col("len") - 1).cast("long").alias("end_pos"), F.substring(F.col("line"), F.col("i"), F.col("len")).alias("pat"))
    side = F.broadcast(distinct) if sum(r["k"] for r in found) <= BROADCAST_PATTERNS and sum(r["b"] for r in found) <= BROADCAST_BYTES else distinct
    return windows.join(side, "pat").select("line_no", "end_pos", "len", "symbol")


def occurrence_counts(found: DataFrame) -> DataFrame:
    """(symbol, n): occurrences of each pattern, overlaps included."""
    return found.groupBy("symbol").agg(F.count("*").alias("n"))


def counts_by_find(lines: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """The same by finding each pattern in each string: for few patterns, and as a check of occurrence_counts()."""
    names = [f"n{s}" for s, _ in patterns]
    hits = lines.where("line <> ''").select(*(_finds(text).alias(n) for n, (_, text) in zip(names, patterns, strict=True)))
    sums = hits.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.col(n).alias("n")) for n, (s, _) in zip(names, patterns, strict=True)))).alias("r")).select("r.symbol", "r.n").where("n > 0")


def _finds(text: str) -> Column:
    return F.size(F.filter(F.sequence(F.lit(1), F.length("line")), lambda i: F.substring(F.col("line"), i, F.lit(len(text))) == text)).cast("long")


def hit_positions(found: DataFrame) -> DataFrame:
    """(line_no, hits): positions of each string at which one pattern or more ends."""
    return found.select("line_no", "end_pos").distinct().groupBy("line_no").agg(F.count("*").alias("hits"))


def any_match(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The strings that hold a pattern."""
    return lines.join(found.select("line_no").distinct(), "line_no", "left_semi")
