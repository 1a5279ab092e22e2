"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.llm import (
    chat_template, decontaminate, embedding_dedup, fill_in_middle, gram_index, html_extract, language_id, lm_score, minhash_dedup, sentencepiece_trie,
    suffix_dedup, token_counts, toxicity,
)
from talentloom.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text inside a run of ten words of a test item."""
    return decontaminate.hit_digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of cosine 0.9 or more."""
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every whole text against all other texts."""
    return lm_score.backoff_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text before and after masking private details, counted again only around the edits."""
    trees = token_counts.token_trees(table(spark, sf_dir, "documents"))
    return token_counts.count_rows(token_counts.edited(trees, token_counts.mask_private))


def op7_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether they spell it again."""
    return sentencepiece_trie.id_digest(sentencepiece_trie.round_trip(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return language_id.languages(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are at least 0.8 alike."""
    return minhash_dedup.component_rows(minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere, taken out of every text."""
    return suffix_dedup.span_digest(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all texts, their near words counted, their usual forms and roots."""
    return gram_index.spelling_variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut for filling in its middle, and rebuilt from that."""
    return fill_in_middle.row_digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    rows = chat_template.formatted(chat_template.with_trial(table(spark, sf_dir, "conversations")))
    return chat_template.read_back(rows).withColumnRenamed("id", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_benchmark_decontamination, op2_embedding_near_dedup, op3_html_main_text, op4_lm_score, op5_toxicity, op6_token_counts,
        op7_sentencepiece_round_trip, op8_language_id, op9_minhash_near_dedup, op10_suffix_array_dedup,
        op11_spelling_variants, op12_fill_in_middle, op13_chat_formatting)
}
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontaminate.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_chat_formatting": chat_template.SQL,
}
