"""Covers, selection, codes and the codec against brute force."""

import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandex import schema
from strandex.operators import codec, cover, lookup, matching, selection

ENTRIES = [(s, chr(s), 9) for s in range(1, 128)] + [(128, "ab", 5), (129, "abc", 9), (130, "bcd", 7), (131, "aa", 6), (132, "aaaa", 11), (133, "she", 8), (134, "he", 7), (135, "hers", 8)]
CODES = selection.huffman({s: 130 - c for s, _, c in ENTRIES})
CODED = [(s, t, CODES[s]) for s, t, _ in ENTRIES]


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), schema.LINES)


def every_cover(text):
    if not text:
        yield 0, ()
    for s, t, c in ENTRIES:
        if text.startswith(t):
            for cost, rest in every_cover(text[len(t) :]):
                yield c + cost, (s, *rest)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehrs", max_size=7))
def test_cover_is_least(text):
    cost, path = cover.Coverer(ENTRIES)(text)
    strings = {s: t for s, t, _ in ENTRIES}
    assert cost == min(c for c, _ in every_cover(text)) and "".join(strings[s] for s in path) == text


def test_ties_go_to_the_literal_then_the_longer():
    literal = [(s, chr(s), 2) for s in range(97, 123)]
    assert cover.Coverer([*literal, (200, "ab", 4)])("ab")[1] == [97, 98]
    assert cover.Coverer([*literal, (200, "ab", 1), (201, "cd", 1), (202, "abcd", 2)])("abcd")[1] == [202]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=127), max_size=50))
def test_roundtrip(text):
    own = codec.Codec(CODED)
    nbits, payload = own.encode(text)
    assert own.decode(nbits, payload) == text and len(payload) == (nbits + 7) // 8 and nbits == sum(len(CODES[s]) for s in own.cover(text)[1])


def test_broken_bits_are_told():
    own = codec.Codec(CODED)
    nbits, payload = own.encode("zebra")
    with pytest.raises(ValueError):
        own.decode(nbits - 1, payload)


@pytest.mark.parametrize("seed", range(20))
def test_huffman(seed):
    r = random.Random(seed)
    freqs = {s: r.randint(1, 50) for s in range(r.randint(2, 60))}
    codes = selection.huffman(freqs)
    words = sorted(codes.values())
    assert codes.keys() == freqs.keys() and sum(Fraction(1, 2 ** len(c)) for c in words) == 1
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    heap, cost = sorted(freqs.values()), 0
    while len(heap) > 1:
        a, b, *heap = heap
        cost += a + b
        heap = sorted([*heap, a + b])
    assert sum(freqs[s] * len(c) for s, c in codes.items()) == cost


def test_anchor_select():
    chosen = selection.anchor_select([("http://", 100), ("http:/", 90), ("rare", 1), ("gone", 0), ("zz", 60)], 10_000, 10)
    assert [c[0] for c in chosen][:2] == ["http://", "http:/"] and "gone" not in [c[0] for c in chosen] and "rare" not in [c[0] for c in chosen]
    assert len(selection.anchor_select([("http://", 100), ("zz", 60)], 10_000, 1)) == 1
    assert all(n >= 1 for *_, n in chosen)


def test_occurrences(spark):
    lines = ["she hers", "aaaaa", "", "x", "abcd abc"]
    patterns = [(s, t) for s, t, _ in ENTRIES if len(t) > 1]
    df, pats = frame(spark, lines), spark.createDataFrame(patterns, "symbol int, str string")
    want = {(no, i + len(t), len(t), s) for no, line in enumerate(lines) for s, t in patterns for i in range(len(line) - len(t) + 1) if line[i : i + len(t)] == t}
    found = matching.occurrences(df, pats)
    assert {tuple(r) for r in found.collect()} == want
    counts = {r["symbol"]: r["n"] for r in matching.occurrence_counts(found).collect()}
    assert counts == {r["symbol"]: r["n"] for r in matching.counts_by_find(df, patterns).collect()}
    hits = {r["line_no"]: r["hits"] for r in matching.hit_positions(found).collect()}
    assert hits == {no: len({e for n, e, *_ in want if n == no}) for no in {n for n, *_ in want}}
    assert {r["line_no"] for r in matching.any_match(df, found).collect()} == set(hits)


def test_lookups_agree(spark):
    lines = frame(spark, ["a", "b", "a", "abc", ""])
    probes = frame(spark, ["abc", "a", "nope", ""])
    plain = {r["line_no"]: r["value"] for r in lookup.plain(probes, lookup.table(lines)).collect()}
    by_code = {r["line_no"]: r["value"] for r in lookup.encoded(probes, lookup.encoded_table(lines, CODED), CODED).collect()}
    assert plain == by_code == {0: 3, 1: 2, 2: None, 3: 4}
    assert [r["line"] for r in lookup.misses(probes, lookup.table(lines)).collect()] == ["nope"]
