"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import backoff_lm, bpe, chat, cross_tokens, decontamination, ego_join, html_text, line_dedup, phrases, quality, simhash_dedup, sql, suffix_dedup, token_files
from shelfcast.llm.text import remainder, table
from shelfcast.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Roles and rendered turns of all conversations."""
    return chat.format_turns(table(spark, folder, "conversations"))


def op2_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the best window for each item."""
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op3_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every text under a bigram automaton."""
    return backoff_lm.score_texts(table(spark, folder, "documents"), order=2)


def op4_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without its bytes that a string of 100 bytes covers which also starts earlier."""
    return suffix_dedup.find_repeats(table(spark, folder, "documents"), digests=True)


def op5_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every text, learned from four of five labelled ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = remainder(F.col("doc_id"), 5)
    model = quality.fit(docs, labels.where(fold != 0).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of every text to compressed files and read them back."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), path)
    return token_files.read_token_files(spark, path, with_ids=False)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without lines covered by repeated windows."""
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every text."""
    return bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op9_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return ego_join.near_duplicates(table(spark, folder, "embeddings"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.mine_phrases(table(spark, folder, "documents"))


def op12_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract_text(table(spark, folder, "pages"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, and how often linked ids are linked in all texts."""
    return cross_tokens.alignment_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_turns": op1_chat_turns,
        "op2_benchmark_leaks": op2_benchmark_leaks,
        "op3_backoff_scores": op3_backoff_scores,
        "op4_repeated_strings": op4_repeated_strings,
        "op5_quality_scores": op5_quality_scores,
        "op6_token_files": op6_token_files,
        "op7_line_dedup": op7_line_dedup,
        "op8_bpe_round_trip": op8_bpe_round_trip,
        "op9_simhash_near_duplicates": op9_simhash_near_duplicates,
        "op10_near_vectors": op10_near_vectors,
        "op11_phrases": op11_phrases,
        "op12_main_text": op12_main_text,
        "op13_token_alignment": op13_token_alignment,
    }


def all_sql() -> dict[str, str]:
    return dict(sql.STATEMENTS)
