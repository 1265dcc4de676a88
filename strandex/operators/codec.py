"""Lossless encoding of strings by a dictionary's codes, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.operators.cover import Coverer

#: Entries of a finished dictionary: (symbol, string, code).
Coded = tuple[int, str, str]


class Codec:
    """Encoder and decoder of one dictionary."""

    def __init__(self, entries: list[Coded]):
        self.code = {s: c for s, _, c in entries}
        self.cover = Coverer([(s, t, len(c)) for s, t, c in entries])
        self.text = {c: t for _, t, c in entries}
        self.lengths = sorted({len(c) for _, _, c in entries})

    def bits(self, text: str) -> str:
        return "".join(map(self.code.__getitem__, self.cover(text)[1]))

    def encode(self, text: str) -> tuple[int, bytes]:
        """(number of bits, bits as bytes, first bit highest, the last byte filled up with zeros)."""
        bits = self.bits(text)
        size = (len(bits) + 7) // 8
        return len(bits), (int(bits, 2) << (8 * size - len(bits))).to_bytes(size, "big") if bits else b""

    def decode(self, nbits: int, payload: bytes) -> str:
        """The string; a ValueError if the bits end inside a code."""
        bits = f"{int.from_bytes(payload, 'big'):0{8 * len(payload)}b}"[:nbits] if payload else ""
        out, at = [], 0
        while at < len(bits):
            for n in self.lengths:
                if (found := self.text.get(bits[at : at + n])) is not None and at + n <= len(bits):
                    out.append(found)
                    at += n
                    break
            else:
                raise ValueError("bits end inside a code")
        return "".join(out)


def encode(lines: DataFrame, entries: list[Coded]) -> DataFrame:
    """(line_no, nbits, payload). The dictionary, bounded in size, goes out with the tasks; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(entries)
        for b in batches:
            found = [codec.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["line_no", "nbits", "payload"])

    return lines.select("line_no", "line").mapInArrow(run, "line_no long, nbits int, payload binary")


def encode_bits(lines: DataFrame, entries: list[Coded]) -> DataFrame:
    """(line_no, nbits, bits): the code as a string of 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(entries)
        for b in batches:
            found = [codec.bits(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.string())], ["line_no", "nbits", "bits"])

    return lines.select("line_no", "line").mapInArrow(run, "line_no long, nbits long, bits string")


def decode(encoded: DataFrame, entries: list[Coded]) -> DataFrame:
    """(line_no, line) of (line_no, nbits, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(entries)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(n, p) for n, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.string())], ["line_no", "line"])

    return encoded.select("line_no", "nbits", "payload").mapInArrow(run, "line_no long, line string")


def totals(lines: DataFrame, encoded: DataFrame) -> DataFrame:
    """(decoded_bytes: with a line end each, encoded_bytes, n): one row."""
    zero = F.lit(0).cast("long")
    read = lines.select((F.octet_length("line") + 1).cast("long").alias("d"), F.lit(1).cast("long").alias("n"), zero.alias("b"))
    written = encoded.select(zero.alias("d"), zero.alias("n"), F.col("nbits").cast("long").alias("b"))
    sums = read.union(written).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in "dnb"))
    return sums.select(F.col("d").alias("decoded_bytes"), F.floor((F.col("b") + 7) / 8).cast("long").alias("encoded_bytes"), "n")
