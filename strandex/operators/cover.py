"""Optimal covers: cut each string into literals and patterns so that the sum of their costs is least.

Strings are independent and a dictionary is small (a bounded number of patterns), so a cover is computed where the
string is: one Arrow pass, no shuffle. Of covers of equal cost, the literal counts first, then the longer piece,
decided from the string's end as positions are closed in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a dictionary: (symbol, string, cost in bits). Literals have symbols 1 to 127.
Entry = tuple[int, str, int]


class Coverer:
    """Minimum-cost covers with one dictionary."""

    def __init__(self, entries: list[Entry]):
        import ahocorasick

        self.literal = {t: (s, c) for s, t, c in entries if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        longer = [e for e in entries if len(e[1]) > 1]
        for symbol, text, cost in longer:
            self.automaton.add_word(text, (len(text), symbol, cost))
        self.any = bool(longer)
        if longer:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[int, list[int]]:
        """(cost, symbols); a KeyError names a character without a literal."""
        n = len(text)
        if not self.any:
            parts = [self.literal[c] for c in text]
            return sum(c for _, c in parts), [s for s, _ in parts]
        ending: dict[int, list[tuple[int, int, int]]] = {}
        for end, entry in self.automaton.iter(text):
            ending.setdefault(end, []).append(entry)
        cost, symbol, size = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
        for i, c in enumerate(text):
            symbol[i + 1], own = self.literal[c]
            best = cost[i] + own
            for length, s, own in sorted(ending.get(i, ()), reverse=True):
                if cost[i + 1 - length] + own < best:
                    best, symbol[i + 1], size[i + 1] = cost[i + 1 - length] + own, s, length
            cost[i + 1] = best
        path, i = [], n
        while i:
            path.append(symbol[i])
            i -= size[i]
        return cost[n], path[::-1]


def covers(lines: DataFrame, entries: list[Entry]) -> DataFrame:
    """(line_no, cost, path) of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Coverer(entries)
        for b in batches:
            found = [cover(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.int32()))], ["line_no", "cost", "path"])

    return lines.select("line_no", "line").mapInArrow(run, "line_no long, cost long, path array<int>")


def usage(lines: DataFrame, entries: list[Entry]) -> DataFrame:
    """(symbol, uses) over all covers; counted in each batch before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        cover = Coverer(entries)
        for b in batches:
            count = Counter(chain.from_iterable(cover(t.as_py())[1] for t in b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], ["symbol", "n"])

    return lines.select("line").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("uses"))
