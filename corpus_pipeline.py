"""Cleaning and packing of a document table: five stages, one after the other.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame, written as Parquet in the shared folder and read again as the next
one's docs. All but the last give the columns of ``documents``. The results
hold what a classifier and a tokenizer decide, which SQL can't express, so there
is no ``ORACLE_SQL``; the tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickforge.llm import decontaminate, packing, quality, simhash, suffix_dedup
from clickforge.llm.common import read, save

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels of one crc32 fold of four are left out."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.7)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest doc_id and, where
    this has several texts, the smallest hash of one. Other rows of the same
    doc_id stay if they belong to another component; rows without doc_id can't
    be named and stay."""
    named = docs.withColumn("row_text", F.xxhash64("text"))
    groups = save(simhash.near_groups(named, 3, 3, "row_text").where("doc_id is not null").select("group", "doc_id", "row_text"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row_text")).alias("first"))
    gone = groups.join(first, "group").where(F.struct("doc_id", "row_text") != F.col("first")).select("doc_id", "row_text").distinct()
    kept = named.join(gone, ["doc_id", "row_text"], "left_anti")
    if not groups.groupBy("doc_id", "row_text").count().where("count > 1").isEmpty():  # whole rows repeat
        alike = Window.partitionBy("doc_id", "text").orderBy("doc_id")
        kept = kept.withColumn("nth_of_row", F.row_number().over(alike)).where("nth_of_row = 1 or doc_id is null")
    return kept.select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 100 and more that stand earlier; documents of which nothing stays go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    done = suffix_dedup.deduplicate(docs, length=100, keep=rest, as_text=True)
    done = done.where((F.col("n_removed") == 0) | (F.length("kept") > 0)).withColumnRenamed("kept", "text")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the passages of ``benchmark``."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048)
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("benchmarks", without_benchmarks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
