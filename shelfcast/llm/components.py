"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.tables import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), two node ids of one type. Returns (node, root): root is the smallest node that can be reached.

    Nodes without links don't appear. Alternating star operations: every node's larger neighbours are
    linked to its smallest neighbour, then every node's smaller ones. Each turn only rewires links, so the
    table never grows beyond the links, whatever the size of a component; the turns needed grow with the
    logarithm of the longest path. Each turn is written to the shared folder, which cuts the lineage, and
    the one before is deleted.
    """
    spark = links.sparkSession
    now, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("least"))
        joined = wide.join(least, "a")
        near = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b"))).distinct()
        following, following_path = stored(near, "links")
        row = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = following, following_path
        if tuple(row) == state:
            break
        state = tuple(row)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
