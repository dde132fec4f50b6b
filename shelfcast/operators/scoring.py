"""Metric tables, rankings and matrices from long prediction tables.

A prediction table has one row per model and panel row: ``model, store, item, date,
y, yhat``. Keys travel with the values; nothing is aligned by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import SERIES, SERIES_DAY
from shelfcast.functions.error_metrics import METRICS, SMOOTHING, all_metrics, mape, smape
from shelfcast.operators.splits import TRAILING_ROWS, trailing_rows

# Horizon labels of the score matrix, in column order.
MATRIX_HORIZONS = ("Historical", "1 Month", "3 Months", "1 Year")


def long_predictions(wide: DataFrame, models: Mapping[str, str], y: str = "sales", keep: Sequence[str] = SERIES_DAY) -> DataFrame:
    """Turn one prediction column per model into a row per model."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("yhat")) for m, c in models.items()))
    return wide.select(*keep, F.col(y).cast("double").alias("y"), F.inline(rows)).select(
        "model", *keep, "y", "yhat"
    )


def score(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The five metrics per group, in one aggregation with map-side partials."""
    return predictions.groupBy(*by).agg(*all_metrics())


def smoothed_percentage_errors(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Percentage errors with a small constant in the denominators and no rows left out."""
    return predictions.groupBy(*by).agg(
        mape(smoothing=SMOOTHING).alias("mape_smoothed"), smape(smoothing=SMOOTHING).alias("smape_smoothed")
    )


def score_trailing(
    predictions: DataFrame, windows: Mapping[str, int] = TRAILING_ROWS, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Metrics on the last n rows of each series (all its rows if it has fewer), per window."""
    tail = trailing_rows(predictions, dict(windows), keys=("model", *SERIES))
    return score(tail, (*by, "window"))


def timeline_summary(predictions: DataFrame) -> DataFrame:
    """Per model and series: mean and population std of both sides, MAE, RMSE."""
    e = F.col("y") - F.col("yhat")
    return predictions.groupBy("model", *SERIES).agg(
        F.count("*").alias("n_rows"),
        F.avg("y").alias("actual_mean"),
        F.stddev_pop("y").alias("actual_std"),
        F.avg("yhat").alias("pred_mean"),
        F.stddev_pop("yhat").alias("pred_std"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def on_common_keys(predictions: DataFrame, n_models: int) -> DataFrame:
    """Only the rows that all ``n_models`` models predicted, so that models are ranked on
    the same rows. A group of the window holds one row per model."""
    shared = Window.partitionBy(*SERIES_DAY)
    return (
        predictions.withColumn("_k", F.count("*").over(shared))
        .where(F.col("_k") == n_models)
        .drop("_k")
    )


def rank_models(metrics: DataFrame) -> DataFrame:
    """Metrics plus ``rank`` by rising RMSE. The table has one row per model."""
    order = Window.partitionBy(F.lit(0)).orderBy("rmse", "model")
    return metrics.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def unpivot_metrics(metrics: DataFrame, keep: Sequence[str] = ("model",)) -> DataFrame:
    return metrics.unpivot(list(keep), list(METRICS), "metric", "value")


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """The best model for each metric: the largest R², the smallest of the others."""
    goal = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy("metric").orderBy(F.asc_nulls_last("goal"), "model")
    return (
        unpivot_metrics(metrics)
        .withColumn("goal", goal)
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") == 1)
        .select("metric", "model", "value")
    )


def combine(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def join_actuals(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecast rows with the actual value of the same series and date."""
    return forecast.join(actuals.select(*SERIES_DAY, F.col("sales").cast("double").alias("y")), list(SERIES_DAY))


def horizon_matrix(scores: DataFrame, horizons: Sequence[str] = MATRIX_HORIZONS) -> DataFrame:
    """From ``(model, horizon, metrics)`` to one row per model and metric with a column per horizon.

    A horizon without scores is NULL.
    """
    long = unpivot_metrics(scores, ("model", "horizon"))
    return long.groupBy("model", "metric").pivot("horizon", list(horizons)).agg(F.first("value"))


def macro_average(per_series: DataFrame, item=None) -> DataFrame:
    """Mean over series of MAPE and SMAPE per model and horizon; the same for one item."""
    only = F.col("item") == item if item is not None else F.lit(False)

    def pair(metric: str) -> list[Column]:
        return [F.avg(metric).alias(metric), F.avg(F.when(only, F.col(metric))).alias(f"{metric}_item")]

    return per_series.groupBy("model", "horizon").agg(F.count("*").alias("n_series"), *pair("mape"), *pair("smape"))


def results_matrix(macro: DataFrame, horizons: Sequence[str], suffix: str = "") -> DataFrame:
    """One row per model, a column per horizon and metric, two decimals."""
    values = [F.first(F.round(F.col(f"{m}{suffix}"), 2)).alias(m) for m in ("mape", "smape")]
    return macro.groupBy("model").pivot("horizon", list(horizons)).agg(*values)
