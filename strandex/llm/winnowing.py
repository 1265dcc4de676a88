"""Document fingerprints by winnowing, with Spark's own functions only.

Every k code points in a row have a rolling polynomial hash modulo the prime 2**31 - 1, the sum of code_j * BASE**(k-1-j),
where a code is a character's 31-bit hash. The hash rolls by doubling: that of 2m characters at i is that of m at i times
BASE**m plus that of m at i + m, so k characters take log2(k) passes over the text's array. Of each WINDOW of such hashes
in a row the least is chosen, the rightmost of equals; minima of windows double in the same way. A text of fewer hashes
is one window, and one of fewer than k characters is one hash. So any two texts that share WINDOW + k - 1 characters in a
row, at any offsets, share a chosen hash, and none of fewer than k characters is matched.

The fingerprint is the chosen (character position, hash) pairs in order; likeness is the Jaccard index of two texts'
chosen hashes (1 for two empty texts).

The edited text of a text is its front and the front of the next one. Its windows lie in the one, in the other, or across
the seam; those in a front are chosen as they are in the whole text, so only WINDOW + k - 2 characters on both sides of
the seam are hashed again. A pair's first window, by which a front's pairs are told, follows from the pair before it.

For the comparison with the next document by id, rows are dealt to ranges of ids, the range bounds being ids of the
table (percentiles, an array of fixed length). A range's first row is also sent to the range before it, so each row has
its successor beside it, and only one exchange moves texts.

Defined results: null is an empty text; equal texts have equal fingerprints; rows with one id follow each other by text;
rows with a null id come first, by a hash of their text (ids under -2**62 among them); a single row is its own successor;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.llm.common import partitions

K, WINDOW = 8, 16
#: Hashes have 31 bits; a chosen pair is one long, position << 31 | hash.
BITS = 31
PRIME, BASE = (1 << BITS) - 1, 1103515245


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _after(array: str, step: int) -> Column:
    """The array from its entry `step` on."""
    return F.slice(array, step + 1, F.greatest(F.size(array) - step, F.lit(0)))


def _joined(left: str, right: str, left_length: int, right_length: int) -> Column:
    """Hashes of left_length + right_length characters from the arrays `left` and `right` of hashes of fewer."""
    power = pow(BASE, right_length, PRIME)
    return F.zip_with(left, _after(right, left_length), lambda x, y: (x * _long(power) + y) % _long(PRIME))


def _least(array: str, step: int) -> Column:
    return F.zip_with(array, _after(array, step), lambda x, y: F.least(x, y))


def _fingerprinted(df: DataFrame, text: str, name: str, k: int, window: int, short: Column | None = None) -> DataFrame:
    """Adds `name`, the chosen pairs of the text column. Steps are columns of their own, so that none is computed twice.

    `short`: whether a text of less than one whole window has pairs (null: always).
    """
    keep = list(df.columns)
    short = F.lit(True) if short is None else short
    n = F.length(text)
    out = df.select(*keep, short.alias("__short"), F.transform(F.split(text, ""), lambda c: F.xxhash64(c).bitwiseAND(_long(PRIME)) % _long(PRIME)).alias("__p"), F.lit(None).cast("array<bigint>").alias("__h"))
    length, done, rest = 1, 0, k
    while rest:  # hashes of `length` characters in __p, of `done` in __h
        if rest & 1:
            out = out.withColumn("__h", _joined("__h", "__p", done, length) if done else F.col("__p"))
            done += length
        rest >>= 1
        if rest:
            out = out.withColumn("__p", _joined("__p", "__p", length, length))
            length *= 2
    whole = F.transform(F.slice("__h", 1, F.greatest(n - (k - 1), F.lit(0))), lambda h, i: F.shiftleft(h, BITS) - i)
    one = F.array(F.shiftleft(F.xxhash64(text).bitwiseAND(_long(PRIME)), BITS))
    out = out.select(*keep, "__short", F.when(n >= k, whole).when(n > 0, one).otherwise(F.array().cast("array<bigint>")).alias("__m"))
    size = 1
    grams = F.greatest(n - (k - 1), F.lit(1))
    out = out.withColumn("__g", F.col("__m"))
    while size < window:
        step = min(size, window - size)
        out = out.withColumn("__m", _least("__m", step))
        size += step
    least = F.when(grams >= window, F.array_distinct(F.slice("__m", 1, F.greatest(grams - (window - 1), F.lit(0))))).when(F.col("__short") & (n > 0), F.array(F.array_min("__g"))).otherwise(F.array().cast("array<bigint>"))
    out = out.select(*keep, least.alias("__c"))

    def pair(m: Column) -> Column:
        at = F.negate(m).bitwiseAND(_long(PRIME))
        return F.shiftleft(at, BITS).bitwiseOR(F.shiftright(m + at, BITS))

    return out.select(*keep, F.transform("__c", pair).alias(name))


def _at(pair: Column) -> Column:
    return F.shiftright(pair, BITS)


def _hash(pair: Column) -> Column:
    return pair.bitwiseAND(_long(PRIME))


def _of_front(pairs: Column, length: Column, k: int, window: int) -> Column:
    """Of the pairs of a whole text, those that a whole window inside its first `length` characters chooses."""

    def inside(p: Column, i: Column) -> Column:
        before = F.get(pairs, i - 1)
        first = F.when(i == 0, _long(0)).when(_hash(p) <= _hash(before), _at(p) - (window - 1)).otherwise(_at(before) + 1)
        return first <= length - (k + window - 1)

    return F.when(length >= k + window - 1, F.filter(pairs, inside)).otherwise(F.array().cast("array<bigint>"))


def _moved(pairs: Column, by: Column) -> Column:
    return F.transform(pairs, lambda p: p + F.shiftleft(by.cast("long"), BITS))


def spelled(pairs: Column) -> Column:
    """A fingerprint as text: position:hash in hexadecimal, in order, joined by spaces."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(_at(p).cast("string"), F.lit(":"), F.lower(F.hex(_hash(p))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of hashes."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint: array of (at, h))."""
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    pairs = F.transform("fingerprint", lambda p: F.struct(_at(p).cast("int").alias("at"), _hash(p).alias("h")))
    return _fingerprinted(base, "t", "fingerprint", k, window).select(F.col("id").alias(id_col), pairs.alias("fingerprint"))


def _dealt(base: DataFrame) -> DataFrame:
    """Rows (id, t) with `range`, the range of ids that they are dealt to, and `extra`: 0, or 1 for a copy of a range's
    first row in the range before it (2 in the last range, for the first row of all)."""
    n = partitions(base.sparkSession)
    shares = [j / (2 * n) for j in range(1, 2 * n)]
    found = base.agg(F.percentile_approx("o", shares, 100 * n).alias("b"), F.min("o").alias("least")).first()  # 2 * n ids at most
    bounds = sorted({*(found["b"] or []), 0 if found["least"] is None else found["least"]})
    step = math.isqrt(len(bounds)) + 1
    pages = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    page = F.greatest(F.size(F.filter(longs([p[0] for p in pages]), lambda b: b <= F.col("o"))) - 1, F.lit(0))
    paged = base.withColumn("page", page)
    own = F.get(F.array(*map(longs, pages)), F.col("page"))
    placed = paged.withColumn("range", F.col("page") * step + F.size(F.filter(own, lambda b: b <= F.col("o"))) - 1).withColumn("first", F.array_contains(own, F.col("o"))).drop("page")
    before = F.when(F.col("range") > 0, F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("extra"))).otherwise(F.struct(F.lit(len(bounds) - 1).alias("range"), F.lit(2).alias("extra")))
    itself = F.struct(F.col("range"), F.lit(0).alias("extra"))
    return placed.select("id", "o", "t", F.explode(F.when(F.col("first"), F.array(itself, before)).otherwise(F.array(itself))).alias("c")).select("id", "o", "t", "c.range", "c.extra")


def compare_with_edited(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last floor(n/2) code points replaced by the first as many, or
    all, of the next document by ascending id (after the last: the first).

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    order = F.coalesce(docs[id_col].cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) - _long(2**62) - _long(2**62))
    base = docs.select(docs[id_col].alias("id"), order.alias("o"), text.alias("t"))
    marked = _fingerprinted(_dealt(base).repartition("range"), "t", "fp", k, window)
    follow = Window.partitionBy("range").orderBy("extra", "o", "t")
    paired = marked.select("*", F.lead("t").over(follow).alias("next_t"), F.lead("fp").over(follow).alias("next_fp")).where("extra = 0")
    half = F.floor(F.length("t") / 2).cast("int")
    fronts = paired.select("id", "t", "next_t", "fp", "next_fp", F.length("t").alias("n"), (F.length("t") - half).alias("front"), F.least(half, F.length("next_t")).alias("other"))
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.col("front")), F.substring(F.col("next_t"), F.lit(1), F.col("other")))
    reach = k + window - 2  # characters of a window across the seam that can lie on one side
    begin = F.greatest(F.col("front") - reach, F.lit(0))
    seam = F.concat(F.substring(F.col("t"), begin + 1, F.col("front") - begin), F.substring(F.col("next_t"), F.lit(1), F.least(F.col("other"), F.lit(reach))))
    cut = fronts.select("id", "n", "front", "other", "fp", "next_fp", F.sha2(edited, 256).alias("edited_sha256"), seam.alias("seam"), begin.alias("begin"))
    # a seam of less than a window has pairs only where it is the whole edited text
    across = _fingerprinted(cut, "seam", "seam_fp", k, window, F.col("front") + F.col("other") <= reach)
    edited_fp = F.array_distinct(F.concat(_of_front(F.col("fp"), F.col("front"), k, window), _moved(F.col("seam_fp"), F.col("begin")), _moved(_of_front(F.col("next_fp"), F.col("other"), k, window), F.col("front"))))
    compared = across.select("id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fp", "next_fp", edited_fp.alias("edited_fp"))
    hashes = lambda c: F.transform(c, _hash)
    apart = compared.select("*", hashes(F.col("fp")).alias("a"), hashes(F.col("edited_fp")).alias("b"), hashes(F.col("next_fp")).alias("c"))
    return apart.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", spelled(F.col("fp")).alias("fingerprint"), spelled(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
