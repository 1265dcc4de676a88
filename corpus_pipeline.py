"""Corpus pipeline: quality rules, toxicity, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whole
rows of its predecessor's output less what the stage decides to drop or cut. run() writes each stage as Parquet in the
folder that spark.checkpoint.dir names and reads it again.

Defined results: an empty table gives no rows; a null or empty text fails the quality rules and goes; further columns, of
any name, pass through to the last stage; near-dedup keeps one row of a component, repeated rows and ids included; rows with
a null id lose no words in substring dedup and are packed with a null id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common, packing, quality, simhash, substring_dedup, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the threshold table keeps. The rules see one row at a time, so rows are filtered in place."""
    return quality.keep(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted to be toxic."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, of those with the least id, of each component of SimHash links; a null id is greater than all.

    Rows are told apart by id and text, not by their place, which a lost executor may change. Only where such a row is
    repeated, the kept rows are also compared with each other.
    """
    key = _unused("row", docs)
    marked = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    found = simhash.near_duplicates(marked, id_col=key).where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("kept")).agg(F.count("*").alias("n"))
    least = common.cut(found)
    left = marked.join(least.select("kept").hint("shuffle_hash"), marked[key].eqNullSafe(F.col("kept")), "left_semi")
    return (left if least.where("n > 1").isEmpty() else left.dropDuplicates([key, "text"])).drop(key)


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages that an earlier document holds out of the texts; n_chars counts what is left."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into windows of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", non_toxic),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: The stages need hashes, votes, components and tokens that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    shared = common.shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
