"""A corpus pipeline: documents are filtered, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, folder of the tables) and returns a table, which is written to the shared
folder and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, decontamination, line_dedup, quality, simhash_dedup
from shelfcast.llm.tables import discard, stored
from shelfcast.llm.text import table

#: Score below which a document is rejected.
LEAST_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, learned from all labelled ones, doesn't reject.

    A null or empty text gets the score of the bias alone; equal texts get equal scores, so repeated rows stay or go together. Without
    labels every score is one half and all stay. An empty table stays empty; other columns are kept as they are.
    """
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels, LEAST_QUALITY)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without lines that repeated windows cover; n_chars follows the text.

    Every row stays, null and empty texts as they are. Of equal windows the first by doc_id (null first), hash of the text and place stays;
    equal rows are one text and lose the same lines. An empty table stays empty; other columns are kept.
    """
    found = line_dedup.dedup_lines(docs, counts=False)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose fingerprints are linked.

    The row with the smallest doc_id stays (null last), of equal ones that with the smallest hash of its text, of equal rows one. Null, empty and
    blank texts have fingerprint zero and so are one group. An empty table stays empty; other columns are kept.
    """
    return simhash_dedup.one_of_each(docs)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts, and those of fewer than five words, hold none. Equal rows stay or go together. With an empty benchmark all
    stay; an empty table stays empty; other columns are kept.
    """
    return decontamination.without_leaks(docs, table(spark, folder, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row per document.

    A null text is the empty text, without ids. Repeated rows give equal rows, an empty table none; other columns are left out.
    """
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_items),
    ("BPE encoding and decoding", encoded),
]

# SQL states neither the trained classifier nor the hashes; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the table documents."""
    docs, path = table(spark, folder, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        done, new = stored(stage(spark, docs, folder), f"stage-{number}")
        if path is not None:
            discard(spark, path)
        docs, path = done, new
    return docs
