"""How texts are dealt into groups."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from shelfcast.llm import backoff_lm, chat, suffix_dedup
from shelfcast.llm.text import dealt_by, partitions, text_groups, utf8


def test_every_group_has_a_partition_of_its_own(spark):
    rows = spark.range(2000).withColumn("grp", F.pmod("id", F.lit(51)).cast("int"))

    def once(table: pa.Table) -> pa.Table:
        return table.select(["grp"]).slice(0, 1)

    found = dealt_by(rows, 51, "grp").groupBy("grp").applyInArrow(once, "grp int").withColumn("part", F.spark_partition_id()).collect()
    assert len(found) == 51 == len({r.part for r in found}) and all(r.part == r.grp for r in found)


def test_groups_follow_the_bytes_of_the_texts(spark):
    docs = spark.range(100).select(F.repeat(F.lit("é"), 500).alias("text"))
    assert text_groups(docs) == partitions(docs)
    assert text_groups(docs, 1000) == 100 and text_groups(docs.limit(0), 1) == partitions(docs)
    assert text_groups(docs.withColumn("text", F.lit(None).cast("string")), 1) == partitions(docs)


def test_texts_are_shuffled_by_group_number_only(spark, documents, tables):
    """No exchange by hash is put between the groups, which would deal the texts once more."""
    for df in (suffix_dedup.find_repeats(documents), backoff_lm.score_texts(documents), chat.format_turns(spark.read.parquet(f"{tables}/conversations.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning", plan) and "direct_shuffle_partition_id" in plan


def test_chunks_are_joined_with_wide_offsets():
    data, offsets = utf8(pa.chunked_array([["ab", None], ["", "cd"]], pa.string()))
    assert data.tobytes() == b"abcd" and offsets.tolist() == [0, 2, 2, 2, 4]
    assert utf8(pa.chunked_array([], pa.string()))[1].tolist() == [0]
