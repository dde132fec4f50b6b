"""Dense codes and global positions without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

def with_global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of each row in the total order ``order``, which must be unique.

    The rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before theirs. The numbered rows are
    written down, so that sizes and rows stem from the same sort even if an executor
    is lost. The only unpartitioned step sees one row per partition.
    """
    numbered = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "positions")
    parted = numbered.withColumns(
        {"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_size"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return (
        parted.join(F.broadcast(shifts), "_part")  # one row per sort partition
        .withColumn(name, F.col("_shift") + F.col("_row"))
        .drop("_part", "_row", "_id", "_shift")
    )


def category_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Table ``(column, code)``: distinct non-null labels numbered from 0 in sorted order."""
    name = name or f"{column}_code"
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = with_global_position(labels, [column], name)
    return coded.withColumn(name, F.col(name).cast("int"))


def with_category_codes(df: DataFrame, columns: Sequence[str], labels_from: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_code`` for each column; the labels are kept beside the codes.

    ``labels_from`` may name a cheaper frame that holds the same labels. A row without
    a label has code -1. The code tables are stored, so Spark broadcasts one only when
    its measured size allows, and otherwise joins by shuffle.
    """
    for column in columns:
        codes = category_codes(df if labels_from is None else labels_from, column)
        df = df.join(codes, column, "left").fillna({f"{column}_code": -1})
    return df
