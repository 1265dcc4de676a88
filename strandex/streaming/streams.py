"""Streams: encode strings as they come, count k-grams in event time. Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.operators import codec
from strandex.sources.lines import is_valid


def encode_stream(stream: DataFrame, entries: list[codec.Coded]) -> DataFrame:
    """(line_no, nbits, payload) of a stream (line_no, line): stateless, invalid lines dropped."""
    return codec.encode(stream.where(is_valid(F.col("line"))), entries)


def kgram_counts(stream: DataFrame, k: int, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, kgram, n) for each event-time window of a stream (ts, line); late rows are waited for as long as `late`."""
    marked = stream.withWatermark(time, late).where(F.length("line") >= k)
    grams = marked.select(time, F.explode(F.transform(F.sequence(F.lit(1), F.length("line") - k + 1), lambda i: F.substring(F.col("line"), i, F.lit(k)))).alias("kgram"))
    return grams.groupBy(F.window(time, window).alias("w"), "kgram").agg(F.count("*").alias("n")).select("w.start", "w.end", "kgram", "n")
