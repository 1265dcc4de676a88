"""Whole runs: build, encode with a check, lookup comparison, timing of encodes, pattern hits."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.operators import codec, lookup, matching
from strandex.plans.dictionary import RECOMMENDED, Dictionary, Params, build, size_bytes, stats
from strandex.sources import store


def build_and_store(spark: SparkSession, lines: DataFrame, path: str, params: Params = RECOMMENDED, delimiters: str | None = None) -> Dictionary:
    dictionary = build(lines, params, delimiters)
    store.store(dictionary, spark, path)
    return dictionary


def differing(lines: DataFrame, dictionary: Dictionary) -> DataFrame:
    """The lines that do not come back from encoding and decoding: none."""
    back = codec.decode(codec.encode(lines, dictionary.coded()), dictionary.coded()).withColumnRenamed("line", "back")
    return lines.join(back, "line_no", "left").where(~F.col("line").eqNullSafe(F.col("back")))


def encode_report(spark: SparkSession, lines: DataFrame, dictionary: Dictionary, verify: bool = False) -> DataFrame:
    """One row: bytes in and out, dictionary size, ratios, seconds, MiB a second, the dictionary's figures and parameters."""
    began = time.perf_counter()
    row = codec.totals(lines, codec.encode(lines, dictionary.coded())).first()
    seconds = time.perf_counter() - began
    if verify and (bad := differing(lines, dictionary).count()):
        raise AssertionError(f"{bad} lines do not come back")
    frame = dictionary.frame(spark)
    size, about, params = size_bytes(frame).first()["dict_size"], stats(frame, dictionary.records).first(), dictionary.params
    read, out = row["decoded_bytes"], row["encoded_bytes"]
    report = {
        "n": row["n"], "decoded_bytes": read, "encoded_bytes": out, "dict_size": size, "ratio": out / max(read, 1), "ratio_with_dict": (out + size) / max(read, 1),
        "seconds": seconds, "mib_per_s": read / max(seconds, 1e-9) / 2**20, "symbols": about["symbols"], "patterns": about["patterns"], "max_code_len": about["max_code_len"],
        "max_pattern_len": about["max_pattern_len"], "pattern_chars": about["pattern_chars"], "n1": params.n1, "n2": params.n2, "k": params.k, "r": params.r,
    }
    return _row(spark, report)


def test(spark: SparkSession, lines: DataFrame, path: str, params: Params = RECOMMENDED, delimiters: str | None = None, verify: bool = True) -> DataFrame:
    """Build, store, load again, encode everything, check that it comes back."""
    build_and_store(spark, lines, path, params, delimiters)
    return encode_report(spark, lines, store.load(spark, path), verify)


def test_lookup(lines: DataFrame, probes: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(line_no, value, encoded_value): both lookups side by side; they agree."""
    a = lookup.plain(probes, lookup.table(lines)).select("line_no", "value")
    b = lookup.encoded(probes, lookup.encoded_table(lines, dictionary.coded()), dictionary.coded()).withColumnRenamed("value", "encoded_value")
    return a.join(b, "line_no")


def lookup_report(spark: SparkSession, lines: DataFrame, probes: DataFrame, dictionary: Dictionary) -> DataFrame:
    """One row: probes, misses, differing answers (none), bytes of both kinds of keys, the dictionary's size, the ratio of key
    bytes with and without it, seconds and lookups a second of both lookups, the parameters."""
    entries = dictionary.coded()
    plain, coded = lookup.table(lines), lookup.encoded_table(lines, entries)
    sizes, size, n = lookup.key_sizes(plain, coded).first(), size_bytes(dictionary.frame(spark)).first()["dict_size"], probes.count()
    seconds = [_seconds(lookup.plain(probes, plain)), _seconds(lookup.encoded(probes, coded, entries))]
    told = test_lookup(lines, probes, dictionary).agg(F.sum(F.col("value").isNull().cast("long")).alias("misses"), F.sum((~F.col("value").eqNullSafe(F.col("encoded_value"))).cast("long")).alias("different")).first()
    before, after, params = sizes["plain_key_bytes"] or 0, sizes["encoded_key_bytes"] or 0, dictionary.params
    return _row(spark, {
        "n": n, "misses": told["misses"] or 0, "different": told["different"] or 0, "keys": sizes["n_plain"], "encoded_keys": sizes["n_encoded"], "plain_key_bytes": before, "encoded_key_bytes": after, "dict_size": size,
        "ratio": after / max(before, 1), "ratio_with_dict": (after + size) / max(before, 1), "seconds": seconds[0], "encoded_seconds": seconds[1], "lookups_per_s": n / max(seconds[0], 1e-9), "encoded_lookups_per_s": n / max(seconds[1], 1e-9),
        "symbols": len(entries), "n1": params.n1, "n2": params.n2, "k": params.k, "r": params.r,
    })


def match_report(spark: SparkSession, lines: DataFrame, dictionary: Dictionary, repeats: int = 1) -> DataFrame:
    """One row: positions with a hit in all lines, bytes read, seconds and MiB a second over `repeats` runs."""
    found = hits(spark, lines, dictionary)
    read = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    seconds = sum(_seconds(found) for _ in range(repeats))
    return _row(spark, {"hits": found.agg(F.sum("hits")).first()[0] or 0, "decoded_bytes": read, "repeats": repeats, "seconds": seconds, "mib_per_s": repeats * read / max(seconds, 1e-9) / 2**20})


def _seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def _row(spark: SparkSession, report: dict[str, int | float]) -> DataFrame:
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{name} {'double' if isinstance(v, float) else 'long'}" for name, v in report.items()))


def sample_encodes(lines: DataFrame, dictionary: Dictionary, sets: int = 10, size: int = 10_000, repeats: int = 20, seed: int = 42) -> list[float]:
    """Seconds for each random set of lines, encoded `repeats` times."""
    total = max(lines.count(), 1)
    times = []
    for k in range(sets):
        chosen = lines.sample(True, size / total, seed + k)
        began = time.perf_counter()
        for _ in range(repeats):
            codec.encode(chosen, dictionary.coded()).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return times


def hits(spark: SparkSession, lines: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(line_no, hits): positions at which a pattern of the dictionary ends."""
    return matching.hit_positions(matching.occurrences(lines, store.patterns_only(dictionary.frame(spark))))
