"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontaminate, divergence, huffman, kneser_ney, licenses, packing, quality, quality_rules, simhash, suffix_dedup, token_counts
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(read(spark, sf_dir, "documents"), folds=7, held_out=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(read(spark, sf_dir, "documents"), length=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_distance=3)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "n_near")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).drop("lang", "source")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = huffman.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_licenses_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_licenses, whose SQL fixes its two cuts, with the cut at paragraphs of hard-wrapped files."""
    return licenses.scan(read(spark, sf_dir, "documents"), paragraphs=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"), least=30, top=2000)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language_model": op3_language_model,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_licenses": op9_licenses,
    "op9_licenses_paragraphs": op9_licenses_paragraphs,
    "op10_token_counts": op10_token_counts,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op6_decontamination": decontaminate.oracle_sql(),
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op9_licenses": licenses.oracle_sql(),
    "op11_divergence": divergence.oracle_sql(),
}
