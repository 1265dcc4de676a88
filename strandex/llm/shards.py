"""Contiguous shards of near equal bytes, cut from global prefix sums of sizes.

Rows are put in one order (hash of the text, then id), dealt to partitions by range, and checkpointed; the partitions'
totals, one row each, give every partition its first byte and row number, and a running sum inside gives every row its
own. Shards are cut at equal targets of that sum. A group of equal texts lies together in this order; a cut inside one
moves to the group's nearer end unless the group is larger than `tolerance` of a shard, when it stays inside the group.
Ranges go by hash and id, so a group of a third of all rows spreads over many partitions. Only narrow rows move.

Defined results: a null text has no bytes and the checksum of an empty one, and null and empty texts are two groups;
equal rows are sharded each for itself; with fewer rows than shards some shards are empty; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import cut, partitions


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.01) -> DataFrame:
    """(id, size, text_crc32, shard, slot): slot counts a shard's rows from 0 without gaps."""
    text = docs[text_col]
    narrow = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("crc"),
        F.xxhash64(text, text.isNull()).alias("h"),
    )
    n = partitions(docs.sparkSession)
    ordered = cut(narrow.repartitionByRange(n, "h", "id", "crc").sortWithinPartitions("h", "id", "crc"))
    totals = {r["p"]: (r["bytes"], r["rows"]) for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}  # a row for each partition
    first, at, row = {}, 0, 0
    for p in sorted(totals):
        first[p] = (at, row)
        at, row = at + totals[p][0], row + totals[p][1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's first byte and row number."""
        start, number = first.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            size = b.column(1).to_numpy()
            ends = start + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size), pa.array(np.arange(number, number + len(size)))], ["id", "size", "crc", "h", "start", "number"])
            if len(size):
                start, number = int(ends[-1]), number + len(size)

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ordered.mapInArrow(place, f"id {kind}, size long, crc long, h long, start long, number long")
    cuts = _cuts(placed, at, row, n_shards, tolerance)
    starts = [0, *cuts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begins = np.array(cuts, dtype=np.int64), np.array(starts, dtype=np.int64)
        for b in batches:
            number = b.column(5).to_numpy()
            shard = np.searchsorted(own, number, side="right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shard.astype(np.int32)), pa.array(number - begins[shard])], [id_col, "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(deal, f"`{id_col}` {kind}, size long, text_crc32 long, shard int, slot long")


def _cuts(placed: DataFrame, total: int, rows: int, n_shards: int, tolerance: float) -> list[int]:
    """Row number at which each shard but the first begins; looks at one row and one group for each cut."""
    share = total / n_shards
    targets = [share * k for k in range(1, n_shards)]
    hit = F.lit(False)
    for t in targets:
        hit = hit | ((F.col("start") <= t) & (F.col("start") + F.col("size") > t))
    found = sorted(placed.where(hit).select("h", "start", "size", "number").collect(), key=lambda r: r["number"])
    end = F.col("start") + F.col("size")
    groups = {r["h"]: r for r in placed.where(F.col("h").isin(sorted({r["h"] for r in found}))).groupBy("h").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.min("number").alias("first"), F.max("number").alias("last")).collect()} if found else {}
    cuts: list[int] = []
    for t in targets:
        r = next((r for r in found if r["start"] <= t < r["start"] + r["size"]), None)
        if r is None:
            cuts.append(rows)
            continue
        g = groups[r["h"]]
        if g["end"] - g["start"] <= tolerance * share:
            number = g["first"] if t - g["start"] <= g["end"] - t else g["last"] + 1
        else:
            number = r["number"] + (t - r["start"] > r["start"] + r["size"] - t)
        cuts.append(max(number, cuts[-1] if cuts else 0))
    return cuts
