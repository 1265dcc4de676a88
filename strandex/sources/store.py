"""Stored dictionaries and archives as Parquet, and text and CSV reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import schema
from strandex.functions import scalars
from strandex.operators import codec
from strandex.plans.dictionary import RECOMMENDED, Dictionary, Params, build
from strandex.sources import lines as sources


def store(dictionary: Dictionary, spark: SparkSession, path: str) -> None:
    """Write a dictionary, its parameters and the format's version with every row."""
    rows = dictionary.frame(spark).withColumns({"version": F.lit(schema.DICTIONARY_VERSION), "params": F.lit(json.dumps(asdict(dictionary.params))), "records": F.lit(dictionary.records).cast("long")})
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Dictionary:
    """Read a dictionary; a ValueError if any row has another version."""
    rows = spark.read.parquet(path).collect()  # literals and n2 patterns at most
    if not rows or {r["version"] for r in rows} != {schema.DICTIONARY_VERSION}:
        raise ValueError(f"{path} holds no dictionary of version {schema.DICTIONARY_VERSION}")
    params = Params(**json.loads(rows[0]["params"]))
    return Dictionary(sorted((r["symbol"], r["str"], r["freq"], r["is_literal"], r["code"]) for r in rows), params, rows[0]["records"])


def compress(spark: SparkSession, source: str, target: str, params: Params = RECOMMENDED, delimiters: str | None = "/") -> None:
    """Write an archive of a text file's valid lines: its dictionary and the encoded lines."""
    lines = sources.valid_lines(sources.read_lines(spark, source))
    dictionary = build(lines, params, delimiters)
    store(dictionary, spark, f"{target}/dictionary")
    codec.encode(lines, dictionary.coded()).write.mode("overwrite").parquet(f"{target}/encoded")


def extract(spark: SparkSession, source: str, target: str) -> None:
    """Write an archive's lines as text, in their order."""
    dictionary = load(spark, f"{source}/dictionary")
    lines = codec.decode(spark.read.parquet(f"{source}/encoded"), dictionary.coded())
    sources.write_lines(lines, target)


def dump(dictionary: DataFrame) -> DataFrame:
    """A dictionary as lines of text: symbol, freq, code length, code in hexadecimal, string length, escaped string."""
    code = F.lower(F.hex(scalars.pack_bits(F.col("code"))))
    return dictionary.orderBy("symbol").select("symbol", "freq", "code_len", F.concat(F.lit("0x"), code).alias("code_hex"), F.length("str").alias("str_len"), scalars.hex_escape(F.col("str")).alias("str"))


def patterns_only(dictionary: DataFrame) -> DataFrame:
    """What is left of a dump without the literals."""
    return dictionary.where(~F.col("is_literal"))


def from_symbol(dictionary: DataFrame, symbol: int = 41) -> DataFrame:
    """What is left of a dump from a symbol on."""
    return dictionary.where(F.col("symbol") >= symbol)


def append_report(row: DataFrame, path: str) -> None:
    """Add a row of statistics to a CSV report."""
    row.coalesce(1).write.mode("append").option("header", True).csv(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder that spark.checkpoint.dir names. A local session may go without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.gettempdir()}/strandex-{uuid.uuid4().hex}"
