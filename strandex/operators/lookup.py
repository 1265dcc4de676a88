"""Exact-match lookups by string and by encoded string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.operators import codec


def table(lines: DataFrame) -> DataFrame:
    """(line, value): each string once, with the number of its last line."""
    return lines.groupBy("line").agg(F.max("line_no").alias("value"))


def plain(probes: DataFrame, built: DataFrame) -> DataFrame:
    """(line_no, line, value): value is null where the string is not in the table."""
    return probes.join(built, "line", "left").select("line_no", "line", "value")


def encoded_table(lines: DataFrame, entries: list[codec.Coded]) -> DataFrame:
    """(nbits, payload, value): the table with encoded keys."""
    keys = codec.encode(lines, entries)
    return keys.groupBy("nbits", "payload").agg(F.max("line_no").alias("value"))


def encoded(probes: DataFrame, built: DataFrame, entries: list[codec.Coded]) -> DataFrame:
    """(line_no, value): probes are encoded first and looked up by their bits."""
    return codec.encode(probes, entries).join(built, ["nbits", "payload"], "left").select("line_no", "value")


def misses(probes: DataFrame, built: DataFrame) -> DataFrame:
    return probes.join(built, "line", "left_anti")


def longest_prefix(probes: DataFrame, prefixes: DataFrame, delimiter: str = "/") -> DataFrame:
    """(line_no, prefix): the longest stored prefix that ends at a delimiter or the string's end. Beyond exact lookup."""
    cut = F.filter(F.sequence(F.lit(1), F.length("line")), lambda i: (i == F.length("line")) | (F.substring(F.col("line"), i, F.lit(1)) == delimiter))
    heads = probes.where("line <> ''").select("line_no", F.explode(F.transform(cut, lambda i: F.substring(F.col("line"), F.lit(1), i))).alias("prefix"))
    hits = heads.join(prefixes.select("prefix").distinct(), "prefix")
    return hits.groupBy("line_no").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def key_sizes(built: DataFrame, encoded_built: DataFrame) -> DataFrame:
    """(plain_key_bytes, encoded_key_bytes, n_plain, n_encoded): key bytes of both tables; an encoded key has two bytes of length."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    rows = built.select(F.octet_length("line").cast("long").alias("a"), zero.alias("b"), one.alias("c"), zero.alias("d")).union(encoded_built.select(zero, (F.octet_length("payload") + 2).cast("long"), zero, one))
    names = {"a": "plain_key_bytes", "b": "encoded_key_bytes", "c": "n_plain", "d": "n_encoded"}
    return rows.agg(*(F.coalesce(F.sum(c), zero).alias(n) for c, n in names.items()))


def last_of(lines: DataFrame) -> DataFrame:
    """The last line of each string, by a window: the same table as table(), with all columns of the line."""
    return lines.withColumn("__r", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("line_no")))).where("__r = 1").drop("__r")
