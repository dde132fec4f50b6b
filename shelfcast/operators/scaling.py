"""Scalers: standard (fitted on training rows) and min-max per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from shelfcast import SERIES


def fit_standard(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_std`` (population; 1 for a constant column)."""
    means = [F.expr(f"avg({c})").alias(f"{c}_mean") for c in columns]
    spreads = [F.expr(f"coalesce(nullif(stddev_pop({c}), 0.0D), 1.0D)").alias(f"{c}_std") for c in columns]
    return train.agg(*means, *spreads)


def scale_standard(df: DataFrame, fitted: DataFrame | Row, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its z-score. The one fitted row becomes constants of the plan."""
    p = fitted.first() if isinstance(fitted, DataFrame) else fitted
    return df.withColumns({c: (F.col(c) - p[f"{c}_mean"]) / p[f"{c}_std"] for c in columns})


def unscale_standard(df: DataFrame, fitted: DataFrame | Row, column: str, like: str) -> DataFrame:
    """Bring ``column`` from z-scores back to the units of the fitted column ``like``."""
    p = fitted.first() if isinstance(fitted, DataFrame) else fitted
    return df.withColumn(column, F.col(column) * p[f"{like}_std"] + p[f"{like}_mean"])


def scale_minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, keep_range: bool = False) -> DataFrame:
    """Replace each column by (x - min) / (max - min) within its series, 0 if constant.

    ``keep_range=True`` keeps ``<c>_min`` and ``<c>_max`` for :func:`unscale_minmax`.
    """
    series = Window.partitionBy(*keys)
    ranged = df.withColumns(
        {**{f"{c}_min": F.min(c).over(series) for c in columns}, **{f"{c}_max": F.max(c).over(series) for c in columns}}
    )
    unit = lambda c: F.coalesce(
        F.try_divide(F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")),
        F.when(F.col(c).isNotNull(), 0.0),
    )
    scaled = ranged.withColumns({c: unit(c) for c in columns})
    return scaled if keep_range else scaled.drop(*(f"{c}_{end}" for c in columns for end in ("min", "max")))


def unscale_minmax(df: DataFrame, column: str, like: str) -> DataFrame:
    low, high = F.col(f"{like}_min"), F.col(f"{like}_max")
    return df.withColumn(column, F.col(column) * (high - low) + low)
