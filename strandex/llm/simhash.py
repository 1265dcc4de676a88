"""SimHash near-duplicates by anchor-point covering, and the components of their links.

A fingerprint has a bit set where over half of a text's shingle hashes have it. To find all fingerprints within
`distance` bits of each other, anchors are the words of a covering code on 46 of the 64 bits: two perfect Golay codes of
23 bits, each with every point within radius 3 of exactly one codeword. A fingerprint's home is its nearest anchor. It
is replicated to every anchor within the covering radius plus the threshold, where the threshold is shared by the two
blocks: per block radius 3 + d with the two d adding up to `distance` at most (61 anchors on average for 2 bits, which
doesn't depend on the data). If two fingerprints are linked, the second lies at the first's home by the triangle
inequality, so each home is compared with what was replicated to it: no link is lost, and no bucket is capped.

Equal fingerprints are one point: a group of copies is collapsed by a partial aggregate before anything is dealt out.
Components come from alternating large-star and small-star rounds, each cut by a checkpoint, until nothing changes.

Defined results: a null or blank text has fingerprint zero, linked like any other; a text of fewer words than a shingle
is one shingle; rows with one id are one document; a component's id is its least non-null id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import cut, partitions

SEED = 42
#: A Golay code: its length, covering radius and generator polynomial.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
BLOCKS = (0, 23)  # the first bit of each


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the XXH64 hashes of a text's word shingles, A-Z lower-cased, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(found) - n :].tolist(), strict=True)), np.uint64, n)
    each = hashes.view(np.uint8).reshape(n, 8) + _BYTE_AT
    counts = np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ _BITS  # of each byte's bits
    return int(np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").tobytes()[::-1].hex(), 16)


_BYTE_AT = (256 * np.arange(8)).astype(np.int16)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@lru_cache(maxsize=4)
def _patterns(distance: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndrome of each single bit; for each excess up to distance, error patterns of weight RADIUS + excess (all up to
    RADIUS at excess 0) in order of their syndromes, with the place where each syndrome begins."""
    from itertools import combinations

    check = LENGTH - 12
    column = np.zeros(LENGTH, dtype=np.int64)
    for bit in range(LENGTH):
        v = 1 << bit
        for high in range(LENGTH - 1, check - 1, -1):
            if v >> high & 1:
                v ^= GENERATOR << (high - check)
        column[bit] = v
    by_excess = []
    for excess in range(distance + 1):
        found = []
        for weight in range(RADIUS + 1) if excess == 0 else (RADIUS + excess,):
            for bits in combinations(range(LENGTH), weight):
                s = 0
                for b in bits:
                    s ^= int(column[b])
                found.append((s, sum(1 << b for b in bits)))
        found.sort()
        syndromes = np.array([s for s, _ in found])
        by_excess.append((np.searchsorted(syndromes, np.arange(2**check + 1)), np.array([e for _, e in found], dtype=np.int64)))
    return column, by_excess


def _syndromes(v: np.ndarray, column: np.ndarray) -> np.ndarray:
    s = np.zeros_like(v)
    for bit in range(LENGTH):
        s ^= np.where(v >> bit & 1, column[bit], 0)
    return s


def _near(v: np.ndarray, s: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the value, codeword) for each pattern of the value's syndrome."""
    begins, patterns = table
    n = begins[s + 1] - begins[s]
    owner = np.repeat(np.arange(len(v)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[s], n)
    return owner, v[owner] ^ patterns[at]


def anchors(fingerprints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, anchor) for all anchors that a fingerprint (int64) is replicated to; distance 0 gives homes."""
    column, tables = _patterns(distance)
    parts = [(fingerprints >> first) & ((1 << LENGTH) - 1) for first in BLOCKS]
    syndromes = [_syndromes(p, column) for p in parts]
    owners, found = [], []
    for a in range(distance + 1):
        owner, left = _near(parts[0], syndromes[0], tables[a])
        for b in range(distance + 1 - a):
            again, right = _near(parts[1][owner], syndromes[1][owner], tables[b])
            owners.append(owner[again])
            found.append(left[again] | right << LENGTH)
    return np.concatenate(owners), np.concatenate(found)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def links(points: DataFrame, distance: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints `fp` within `distance` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")

    def deal(near: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_numpy()
                for k in range(0, len(own), 2000):
                    part = own[k : k + 2000]
                    owner, anchor = anchors(part, near)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[owner])], ["anchor", "fp"])

        return run

    homes = points.select("fp").mapInArrow(deal(0), "anchor long, fp long").withColumnRenamed("fp", "a")
    replicas = points.select("fp").mapInArrow(deal(distance), "anchor long, fp long").withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return homes.join(replicas.hint("merge"), "anchor").where(close).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node of its component."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: a node's larger neighbours go to its least neighbour.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to its least neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(small)
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select("v", "v").distinct())
        edges = after


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint: 16 hex digits, component_id: the least id reachable over links)."""
    own = cut(fingerprints(docs, words, id_col, text_col))
    n = partitions(docs.sparkSession)
    points = cut(own.groupBy("fp").agg(F.min("id").alias("least")).repartition(n, "fp"))
    roots = components(links(points, distance))
    joined = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(lowest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
