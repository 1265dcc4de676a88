"""Arrow functions for SQL and columns: encode and decode by a dictionary, CRC-32C."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandex.operators.codec import Coded, Codec

#: The Castagnoli polynomial, bits reversed.
CASTAGNOLI = 0x82F63B78


def encoder(entries: list[Coded]):
    """A function string -> struct<nbits int, payload binary>; null stays null."""

    @F.pandas_udf("nbits int, payload binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(entries)
        for texts in batches:
            found = [(None, None) if t is None else codec.encode(t) for t in texts]
            yield pd.DataFrame({"nbits": pd.array([n for n, _ in found], dtype="Int32"), "payload": [p for _, p in found]})

    return encode


def decoder(entries: list[Coded]):
    """A function (nbits int, payload binary) -> string."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        codec = Codec(entries)
        for nbits, payload in batches:
            yield pd.Series([None if p is None else codec.decode(int(n), bytes(p)) for n, p in zip(nbits, payload, strict=True)], dtype=object)

    return decode


def register(spark: SparkSession, entries: list[Coded], prefix: str = "strandex") -> None:
    """Make <prefix>_encode, <prefix>_decode and <prefix>_crc32c known to SQL."""
    spark.udf.register(f"{prefix}_encode", encoder(entries))
    spark.udf.register(f"{prefix}_decode", decoder(entries))
    spark.udf.register(f"{prefix}_crc32c", crc32c())


@lru_cache(maxsize=1)
def _steps() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CASTAGNOLI if byte & 1 else 0)
        out.append(byte)
    return tuple(out)


def crc32c_of(data: bytes) -> int:
    """CRC-32C of bytes."""
    steps, crc = _steps(), 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ steps[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def crc32c():
    """A function string -> long: CRC-32C of its UTF-8. Spark's own crc32 has another polynomial."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else crc32c_of(t.encode()) for t in texts], dtype="Int64")

    return run
