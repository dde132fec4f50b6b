"""Profile of a panel: overview, moments, group statistics, extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import SERIES
from shelfcast.functions.calendar import day_name, month_name
from shelfcast.functions.moments import kurtosis_corrected, skewness_corrected
from shelfcast.operators.quantiles import histogram, percentiles, value_counts
from shelfcast.session import materialize

# Percentile points and histogram sizes of the profile.
PERCENTILE_POINTS = (0, 25, 50, 75, 90, 95, 99, 100)
SALES_BINS = 50
PAIR_BINS = 50
KEY_BINS = 30


def series_sizes(panel: DataFrame) -> DataFrame:
    """``(store, item, n_rows, first_date, last_date)``: the panel reduced to its series."""
    return panel.groupBy(*SERIES).agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def dataset_overview(panel: DataFrame) -> DataFrame:
    """One row. Distinct counts run on the series table, not on the panel."""
    return (
        series_sizes(panel)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.min("first_date").alias("min_date"),
            F.max("last_date").alias("max_date"),
            F.countDistinct("store").alias("n_stores"),
            F.countDistinct("item").alias("n_items"),
            F.count("*").alias("n_pairs"),
        )
        .withColumns(
            {
                "duration_days": F.datediff("max_date", "min_date"),
                "rows_per_store": F.try_divide("n_rows", "n_stores"),
                "rows_per_item": F.try_divide("n_rows", "n_items"),
            }
        )
    )


def null_counts(df: DataFrame, columns: Sequence[str] = ("sales", "date", "store", "item")) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns))


def stored_counts(df: DataFrame, column: str) -> DataFrame:
    """Value counts, written down once: quantiles, histograms and box plots pass over
    them several times, and they are much smaller than the panel."""
    return materialize(value_counts(df, column), f"{column}-counts")


def moments(panel: DataFrame, column: str = "sales", counts: DataFrame | None = None) -> DataFrame:
    """One row: mean, median, std, min, max, skewness, kurtosis. ``counts``: stored value counts, if there are any."""
    counts = stored_counts(panel, column) if counts is None else counts
    median = percentiles(counts, (50,)).select("value").scalar()
    return panel.agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        skewness_corrected(column).alias("skewness"),
        kurtosis_corrected(column).alias("kurtosis"),
    ).withColumn("median", median)


def sales_percentiles(panel: DataFrame, points: Sequence[float] = PERCENTILE_POINTS) -> DataFrame:
    return percentiles(stored_counts(panel, "sales"), points)


def sales_histogram(panel: DataFrame, bins: int = SALES_BINS, log: bool = False) -> DataFrame:
    value = F.log1p("value") if log else None
    return histogram(stored_counts(panel, "sales"), bins, value)


def _mean_std(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.avg("sales").alias("mean"), F.stddev_samp("sales").alias("std"))


def weekday_profile(panel: DataFrame) -> DataFrame:
    return _mean_std(panel, F.weekday("date"), "dow").withColumn("label", day_name(F.col("dow")))


def month_profile(panel: DataFrame) -> DataFrame:
    return _mean_std(panel, F.month("date"), "month").withColumn("label", month_name(F.col("month")))


def daily_mean(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.avg("sales").alias("mean"))


def store_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("store").agg(
        F.sum("sales").alias("total"), F.avg("sales").alias("mean"), F.count("sales").alias("n_rows")
    )


def top_stores(panel: DataFrame, n: int = 10) -> DataFrame:
    return store_totals(panel).orderBy(F.desc("total"), "store").limit(n)


def item_volatility(panel: DataFrame) -> DataFrame:
    return panel.groupBy("item").agg(F.stddev_samp("sales").alias("std"))


def top_volatile_items(panel: DataFrame, n: int = 10) -> DataFrame:
    return item_volatility(panel).orderBy(F.desc_nulls_last("std"), "item").limit(n)


def key_counts(panel: DataFrame) -> DataFrame:
    """Rows per store, per item and per pair in one pass: ``(level, store, item, n_rows)``.

    The grouping sets run over the series table, so each panel row is shuffled once.
    """
    level = F.grouping_id()
    return (
        series_sizes(panel)
        .groupingSets([["store"], ["item"], ["store", "item"]], "store", "item")
        .agg(F.sum("n_rows").alias("n_rows"), level.alias("gid"))
        .select(
            F.when(F.col("gid") == 1, "store").when(F.col("gid") == 2, "item").otherwise("pair").alias("level"),
            "store",
            "item",
            "n_rows",
        )
    )


def sorted_counts(panel: DataFrame, key: str) -> DataFrame:
    """Rows per key, sorted by key."""
    return panel.groupBy(key).agg(F.count("*").alias("n_rows")).orderBy(key)


def key_count_histogram(panel: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Histogram of the number of rows per key."""
    sizes = panel.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return histogram(stored_counts(sizes, "n_rows"), bins)


def item_store_totals(panel: DataFrame, item) -> DataFrame:
    """Total sales of one item in each store that carries it."""
    return panel.where(F.col("item") == item).groupBy("store").agg(F.sum("sales").alias("total"))


def extremes(panel: DataFrame) -> DataFrame:
    """Largest and smallest groups: ``(what, label, value)``.

    Busiest and quietest weekday, peak and low month, top store, top item and most
    volatile item; ties go to the smallest key. One pass over the panel feeds all of
    them, and each winner is a ``min`` over a struct, so no group is sorted.
    """
    grouped = (
        panel.select("store", "item", "sales", F.weekday("date").alias("dow"), F.month("date").alias("month"))
        .groupingSets([["dow"], ["month"], ["store"], ["item"]], "dow", "month", "store", "item")
        .agg(
            F.avg("sales").alias("mean"),
            F.sum("sales").cast("double").alias("total"),
            F.stddev_samp("sales").alias("std"),
            F.grouping_id().alias("gid"),
        )
    )
    # grouping_id bits, left to right: dow, month, store, item; a grouped key has bit 0.
    dow, month, store, item = 0b0111, 0b1011, 0b1101, 0b1110

    def winner(gid: int, key: str, metric: str, largest: bool) -> Column:
        order = -F.col(metric) if largest else F.col(metric)
        usable = (F.col("gid") == gid) & F.col(metric).isNotNull()
        return F.min(F.when(usable, F.struct(order.alias("o"), F.col(key).alias("key"), F.col(metric).alias("value"))))

    picks = {
        "busiest_day": (winner(dow, "dow", "mean", True), day_name),
        "quietest_day": (winner(dow, "dow", "mean", False), day_name),
        "peak_month": (winner(month, "month", "mean", True), month_name),
        "low_month": (winner(month, "month", "mean", False), month_name),
        "top_store": (winner(store, "store", "total", True), lambda k: k.cast("string")),
        "top_item": (winner(item, "item", "total", True), lambda k: k.cast("string")),
        "most_volatile_item": (winner(item, "item", "std", True), lambda k: k.cast("string")),
    }
    best = grouped.agg(*(column.alias(what) for what, (column, _) in picks.items()))
    rows = F.array(
        *(
            F.struct(F.lit(what).alias("what"), label(F.col(what)["key"]).alias("label"), F.col(what)["value"].alias("value"))
            for what, (_, label) in picks.items()
        )
    )
    return best.select(F.inline(rows))
