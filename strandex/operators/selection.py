"""Choosing a dictionary's patterns, and its codes. Both are sequential over a bounded list and run on the driver."""

from __future__ import annotations

import heapq
import math

#: Bits charged for each trie state that a pattern adds.
STATE_BITS = 4 * 8


def ideal_length(total: float, freq: int) -> float:
    return math.log2(total / freq)


def anchor_select(patterns: list[tuple[str, int]], total: int, most: int) -> list[tuple[str, int, int]]:
    """(pattern, freq, estimated code length) of the chosen, in the order of choice.

    Patterns (string, freq) are taken by falling gain, ties by string. One is accepted if its gain covers the bits of the
    trie states that it adds and of its code; `most` are accepted at most. Frequency 0 is never a candidate.
    """
    ranked = []
    for text, freq in patterns:
        if freq > 0:
            h = ideal_length(total, freq)
            ranked.append((-(freq * (8 * len(text) - h)), text, freq, h))
    prefixes: set[str] = set()
    chosen: list[tuple[str, int, int]] = []
    for negative, text, freq, h in sorted(ranked):
        if len(chosen) == most:
            break
        old = next((n for n in range(len(text), 0, -1) if text[:n] in prefixes), 0)
        if -negative >= (len(text) - old) * STATE_BITS + h:
            prefixes.update(text[:n] for n in range(old + 1, len(text) + 1))
            chosen.append((text, freq, max(1, math.floor(h))))
    return chosen


def huffman(freqs: dict[int, int]) -> dict[int, str]:
    """Prefix-free codes as strings of 0 and 1. Equal frequencies go by the least symbol below; the first taken is 0."""
    if not freqs:
        return {}
    if len(freqs) == 1:
        return {next(iter(freqs)): "0"}
    heap: list[tuple[int, int, object]] = [(f, s, s) for s, f in freqs.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a[2], b[2])))
    codes: dict[int, str] = {}
    todo = [(heap[0][2], "")]
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes
