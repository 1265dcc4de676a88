"""Schemas of the relations that operators pass to each other."""

from __future__ import annotations

LINES = "line_no long, line string"
COMPONENTS = "line_no long, pos long, token string"
HISTOGRAM = "symbol int, ch string, freq long"
KGRAMS = "line_no long, pos long, kgram string, n_pos long"
SERIES = "line_no long, s long, e long, text string"
CANDIDATES = "pat string, real_count long, score long"
DICTIONARY = "symbol int, str string, freq long, is_literal boolean, code_len int, code string"
OCCURRENCES = "line_no long, end_pos long, len int, symbol int"
COVERS = "line_no long, cost long, path array<int>"
ENCODED = "line_no long, nbits int, payload binary"

#: Literals are the characters 1 to 127, each its own symbol; mined patterns follow.
LITERALS = 127
DICTIONARY_VERSION = 2
