"""The whole profile of a panel from one stored copy of it and of its value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import SERIES
from shelfcast.operators import profile, quantiles
from shelfcast.session import materialize


def run(panel: DataFrame) -> dict[str, DataFrame]:
    """Every table of the profile by name.

    The panel is read once and stored; quantiles, histograms and the box plot share one table of value counts.
    """
    panel = materialize(panel, "panel")
    counts = profile.stored_counts(panel, "sales")
    return {
        "overview": profile.dataset_overview(panel),
        "null_counts": profile.null_counts(panel),
        "moments": profile.moments(panel, counts=counts),
        "percentiles": quantiles.percentiles(counts, profile.PERCENTILE_POINTS),
        "histogram": quantiles.histogram(counts, profile.SALES_BINS),
        "log_histogram": quantiles.histogram(counts, profile.SALES_BINS, F.log1p("value")),
        "box_plot": quantiles.box_plot(counts),
        "weekdays": profile.weekday_profile(panel),
        "months": profile.month_profile(panel),
        "daily_mean": profile.daily_mean(panel),
        "top_stores": profile.top_stores(panel),
        "volatile_items": profile.top_volatile_items(panel),
        "key_counts": profile.key_counts(panel),
        "store_counts": profile.sorted_counts(panel, "store"),
        "item_counts": profile.sorted_counts(panel, "item"),
        "rows_per_store": profile.key_count_histogram(panel, ["store"], profile.KEY_BINS),
        "rows_per_item": profile.key_count_histogram(panel, ["item"], profile.KEY_BINS),
        "rows_per_pair": profile.key_count_histogram(panel, SERIES, profile.PAIR_BINS),
        "extremes": profile.extremes(panel),
    }
