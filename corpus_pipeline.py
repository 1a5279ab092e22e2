"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talentloom.llm import decontaminate, language_id, minhash_dedup, sentencepiece_trie, suffix_dedup
from talentloom.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from the labelled ones among them, does not reject; those without letters go."""
    return language_id.without_rejected(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are at least 0.8 alike: the one of least id."""
    return minhash_dedup.without_copies(docs, words=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of their texts that a 200-byte string covers which also starts elsewhere; n_chars follows."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of ten words of a test item."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they spell it again: doc_id, ids, n_pieces, round_trip."""
    return sentencepiece_trie.round_trip(docs)


STAGES = [
    ("identify_language", identify_language),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_round_trip", sentencepiece_round_trip),
]

#: A learned model, removal by bytes and subword ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
