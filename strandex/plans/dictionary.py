"""Building a dictionary from a corpus: mining, two rounds of covers, selection, codes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import schema
from strandex.operators import cover, mining, selection
from strandex.operators.codec import Coded
from strandex.sources import lines as sources


@dataclass(frozen=True)
class Params:
    """n1: k-grams that are told apart in mining; n2: most patterns; r: ratio of similar counts; k: length of k-grams.

    mode "exact" uses running counts of all k-grams; "two_pass" the final counts of the most frequent n1 of them, which
    needs no order.
    """

    n1: int = 1000
    n2: int = 1000
    r: float = 0.9
    k: int = 8
    mode: str = "exact"

    def __post_init__(self):
        if self.k < 2 or self.n2 < 0 or not 0 < self.r <= 1 or self.mode not in ("exact", "two_pass"):
            raise ValueError("k is 2 or more, n2 0 or more, r over 0 and at most 1, mode exact or two_pass")


#: Three sets of parameters in use: the library's, the command line's, and the recommended one.
LIBRARY, COMMAND_LINE, RECOMMENDED = Params(), Params(n1=1100, n2=100, r=0.5, k=3), Params(n1=2000, n2=1000, r=0.5, k=3)


@dataclass
class Dictionary:
    """Entries (symbol, string, freq, is_literal, code), at most the literals and n2 patterns."""

    rows: list[tuple[int, str, int, bool, str]]
    params: Params = field(default_factory=Params)
    records: int = 0

    def coded(self) -> list[Coded]:
        return [(s, t, c) for s, t, _, _, c in self.rows]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, t, f, lit, len(c), c) for s, t, f, lit, c in self.rows], schema.DICTIONARY)


def candidates(components: DataFrame, params: Params, run: int = mining.RUN) -> DataFrame:
    """(pat, real_count, score): the mined strings that are worth trying, bounded by the pool for n2 patterns.

    `run`: how many line numbers are counted in one window; composed numbers need as many times more as a line may take.
    """
    grams = mining.kgrams(components, params.k)
    counted = mining.running_counts(grams, run) if params.mode == "exact" else mining.final_counts(grams, mining.pool_size(params.n1))
    found = mining.series_counts(mining.series(counted, components, params.k, params.r))
    return mining.top_candidates(mining.containment_scores(mining.heavy(found, mining.pool_size(params.n2)), params.k), params.n2)


def build(lines: DataFrame, params: Params = RECOMMENDED, delimiters: str | None = None) -> Dictionary:
    """The dictionary of a corpus (line_no, line) of valid lines; delimiters: mine the components between them.

    The corpus is read five times and never collected. What comes to the driver is bounded by the parameters: 127
    character counts, the candidate pool, and the uses of each.
    """
    mined = lines
    if delimiters:
        mined = sources.numbered_components(lines, delimiters)
    literals = {r["symbol"]: r["freq"] for r in mining.histogram(lines).collect()}
    pool = [(r["pat"], r["real_count"]) for r in candidates(mined, params, mining.RUN << (sources.COMPONENT_BITS if delimiters else 0)).collect()] if params.n2 else []
    total = 1 + sum(literals.values()) + sum(n for _, n in pool)
    return finish(lines, literals, pool, total, params)


def finish(lines: DataFrame, literals: dict[int, int], pool: list[tuple[str, int]], total: int, params: Params) -> Dictionary:
    """Selection and codes for given candidates (string, count)."""
    first = schema.LITERALS + 1
    texts = {s: chr(s) for s in literals} | {first + n: t for n, (t, count) in enumerate(sorted(pool, key=lambda p: p[0])) if count > 0}
    uses = _uses(lines, [(s, t, 1) for s, t in texts.items()])
    costs = {s: max(1, math.floor(selection.ideal_length(total, 1 + uses.get(s, 0)))) for s in literals}
    chosen = selection.anchor_select([(t, 1 + uses.get(s, 0)) for s, t in texts.items() if s >= first], total, params.n2)
    entries = [(s, chr(s), c) for s, c in costs.items()] + [(first + n, t, c) for n, (t, _, c) in enumerate(chosen)]
    again = _uses(lines, entries)
    freqs = {s: 1 + again.get(s, 0) for s, _, _ in entries}
    codes = selection.huffman(freqs)
    return Dictionary([(s, t, freqs[s], s < first, codes[s]) for s, t, _ in sorted(entries)], params, lines.count())


def _uses(lines: DataFrame, entries: list[cover.Entry]) -> dict[int, int]:
    return {r["symbol"]: r["uses"] for r in cover.usage(lines, entries).collect()}


def size_bytes(dictionary: DataFrame) -> DataFrame:
    """(dict_size, dict_bytes): one row. dict_size counts a code by its number of 32-bit words, as the stored form's header
    does; dict_bytes counts the words' bytes."""
    words = F.floor((F.col("code_len") + 31) / 32).cast("long")
    plain = F.lit(4 + 4 + 2 + 2) + F.octet_length("str")
    return dictionary.agg(F.sum(plain + words).cast("long").alias("dict_size"), F.sum(plain + 4 * words).cast("long").alias("dict_bytes"))


def stats(dictionary: DataFrame, records: int) -> DataFrame:
    """One row: symbols, patterns, max_code_len, max_pattern_len, pattern_chars, records."""
    return dictionary.agg(
        F.count("*").alias("symbols"),
        F.sum((~F.col("is_literal")).cast("long")).alias("patterns"),
        F.max("code_len").cast("long").alias("max_code_len"),
        F.max(F.length("str")).cast("long").alias("max_pattern_len"),
        F.sum(F.length("str")).cast("long").alias("pattern_chars"),
    ).withColumn("records", F.lit(records).cast("long"))
