"""Shelfcast: profiling, features, scoring and forecasts for daily sales panels, on Spark.

Every operator takes DataFrames and returns a DataFrame. A *panel* has the
columns ``date, store, item, sales`` with one row per series and day, where a
*series* is one ``(store, item)`` pair.
"""

SERIES = ("store", "item")
SERIES_DAY = ("store", "item", "date")
