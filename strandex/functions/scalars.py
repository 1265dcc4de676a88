"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ideal_length(total: Column, freq: Column) -> Column:
    """Bits of an ideal code: log2(total / freq)."""
    return F.log2(total.cast("double") / freq.cast("double"))


def gain(freq: Column, length: Column, ideal: Column) -> Column:
    """Bits saved by a pattern over plain bytes."""
    return freq * (8 * length - ideal)


def bits_to_words(bits: Column) -> Column:
    """32-bit words that hold so many bits."""
    return F.floor((bits + 31) / 32).cast("long")


def bits_to_bytes(bits: Column) -> Column:
    return F.floor((bits + 7) / 8).cast("long")


def bytes_to_words(size: Column) -> Column:
    return F.floor((size + 3) / 4).cast("long")


def hex_escape(text: Column) -> Column:
    """Characters outside 0x20 to 0x7E become |HH|; only 7-bit text and controls are meant."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^[ -~]$"), c).otherwise(F.concat(F.lit("|"), F.hex(F.encode(c, "utf-8")), F.lit("|")))), "")


def pack_bits(bits: Column) -> Column:
    """A string of 0 and 1 as BINARY, first bit highest, the last byte filled up with zeros."""
    full = F.rpad(bits, (F.floor((F.length(bits) + 7) / 8) * 8).cast("int"), F.lit("0"))
    size = F.length(full)
    parts = F.when(size > 0, F.transform(F.sequence(F.lit(0), (size / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(full, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))).otherwise(F.array().cast("array<string>"))
    return F.unhex(F.array_join(parts, ""))


def get_bits(word: Column, index: Column, width: int) -> Column:
    """Element `index` of an array of `width`-bit fields packed into a long, lowest first."""
    return F.call_function("shiftrightunsigned", word, (index * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def set_bits(word: Column, index: Column, width: int, value: Column) -> Column:
    """The word with element `index` of its `width`-bit fields replaced by the low bits of a value."""
    mask, at = F.lit((1 << width) - 1).cast("long"), (index * width).cast("int")
    cleared = word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", mask, at)))
    return cleared.bitwiseOR(F.call_function("shiftleft", value.cast("long").bitwiseAND(mask), at))


def popcount(word: Column) -> Column:
    return F.bit_count(word)
