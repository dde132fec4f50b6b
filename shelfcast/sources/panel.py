"""Reading, building and storing sales panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast import SERIES, SERIES_DAY

CSV_SCHEMA = "date STRING, store INT, item INT, sales BIGINT"


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan a panel CSV with a header; dates that cannot be read become NULL."""
    rows = spark.read.schema(CSV_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return coerce_dates(rows)


def coerce_dates(rows: DataFrame, column: str = "date") -> DataFrame:
    return rows.withColumn(column, F.try_to_date(column))


def undated_rows(rows: DataFrame, column: str = "date") -> DataFrame:
    """How many rows have a date, and how many have none and will be dropped."""
    return rows.agg(F.count(column).alias("n_dated"), F.count_if(F.col(column).isNull()).alias("n_undated"))


def as_panel(rows: DataFrame) -> DataFrame:
    """Drop undated rows and bring the rest to one row per series and day.

    Repeated days are summed, with a map-side partial sum, so that a hot series is
    reduced before it is shuffled and no series is longer than its days. Every
    window over a series relies on this bound.
    """
    return (
        rows.where(F.col("date").isNotNull())
        .groupBy(*SERIES_DAY)
        .agg(F.sum("sales").cast("bigint").alias("sales"))
        .select("date", "store", "item", "sales")
    )


def panel_from_tables(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    """Units sold per supplier nation (store), part type (item) and ship day.

    No join is hinted: Spark broadcasts a dimension when it is small enough, and
    otherwise sort-merges with adaptive splitting of skewed partitions.
    """
    sold = lineitem.select(
        "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("sales")
    )
    stores = supplier.select("s_suppkey", F.col("s_nationkey").alias("store"))
    items = part.select("p_partkey", F.col("p_type").alias("item"))
    return as_panel(
        sold.join(stores, sold.l_suppkey == stores.s_suppkey).join(items, sold.l_partkey == items.p_partkey)
    )


def read_panel_tables(spark: SparkSession, folder: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return panel_from_tables(table("lineitem"), table("supplier"), table("part"))


def densify(panel: DataFrame) -> DataFrame:
    """Fill the missing days inside each series with zero sales.

    Each row is expanded over the days up to its successor, so no join is needed and
    the partitioning by series is kept for the windows that follow.
    """
    following = F.lead("date").over(Window.partitionBy(*SERIES).orderBy("date"))
    days = F.sequence(F.col("date"), F.coalesce(F.date_sub("following", 1), F.col("date")))
    return (
        panel.withColumn("following", following)
        .select("store", "item", "sales", F.posexplode(days).alias("offset", "date"))
        .select("date", "store", "item", F.when(F.col("offset") == 0, F.col("sales")).otherwise(0).alias("sales"))
    )


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet, clustered by series so that a filter on one series reads few row groups."""
    panel.repartition(*SERIES).sortWithinPartitions(*SERIES_DAY).write.mode("overwrite").parquet(path)


def save_bucketed_panel(panel: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save as a table bucketed and sorted by series; every later window, and every join
    or aggregate by series, then starts without a shuffle."""
    writer = (
        panel.repartition(buckets, *SERIES)
        .write.mode("overwrite")
        .bucketBy(buckets, *SERIES)
        .sortBy(*SERIES_DAY)
        .format("parquet")
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return panel.sparkSession.table(table)
