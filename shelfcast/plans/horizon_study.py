"""The per-series study: windows at three horizons, one model per series, macro averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import SERIES
from shelfcast.functions.calendar import US_HOLIDAYS, with_holiday_flag
from shelfcast.operators.features import HORIZONS, WINDOW_ROWS, direct_windows
from shelfcast.operators.forecast import backtest, hold_and_extend, trend_fitted
from shelfcast.operators.scoring import combine, horizon_matrix, macro_average, results_matrix, score
from shelfcast.operators.series_models import per_series_ridge
from shelfcast.operators.splits import VAL_DAYS, cutoff_date, first_series, with_ratio_split
from shelfcast.plans.training_run import naive_predictions

INPUTS = ("sales", "day_of_week", "month", "holiday")
BACKTEST_HORIZONS = {"1 Month": 30, "3 Months": 90, "1 Year": 365}


def study_frame(panel: DataFrame, holidays: Sequence[str] | DataFrame = US_HOLIDAYS) -> DataFrame:
    dated = panel.withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")})
    return with_holiday_flag(dated, holidays).select("date", *SERIES, *INPUTS)


def windows(panel: DataFrame, holidays: Sequence[str] | DataFrame = US_HOLIDAYS, series: int | None = None) -> DataFrame:
    """Split windows of all series, or of the first ``series`` ones."""
    return with_ratio_split(direct_windows(first_series(study_frame(panel, holidays), series)))


def window_baselines(split_windows: DataFrame) -> DataFrame:
    """Test windows predicted by their last value and by their mean."""
    sales = F.transform("x", lambda r: r["sales"].cast("double"))
    guesses = F.array(
        F.struct(F.lit("last_value").alias("model"), F.element_at(sales, -1).alias("yhat")),
        F.struct(
            F.lit("window_mean").alias("model"),
            (F.aggregate(sales, F.lit(0.0), lambda acc, v: acc + v) / F.size("x")).alias("yhat"),
        ),
    )
    return (
        split_windows.where("split = 'test'")
        .select(*SERIES, "anchor_date", F.col("name").alias("horizon"), F.col("y").cast("double").alias("y"), F.inline(guesses))
        .select("model", *SERIES, "anchor_date", "horizon", "y", "yhat")
    )


def evaluate(predictions: DataFrame, item=None, horizons: Mapping[str, int] = HORIZONS) -> tuple[DataFrame, DataFrame]:
    """Macro averages and their matrix over horizons."""
    macro = macro_average(score(predictions, ("model", "horizon", *SERIES)), item)
    return macro, results_matrix(macro, list(horizons))


def run(panel: DataFrame, holidays: Sequence[str] | DataFrame = US_HOLIDAYS, item=None, series: int | None = None):
    """Macro averages and matrix of the per-series models and the two baselines."""
    frame = first_series(study_frame(panel, holidays), series)
    fitted = per_series_ridge(frame, WINDOW_ROWS)
    return evaluate(combine(fitted, window_baselines(windows(panel, holidays, series))), item)


def backtest_scores(panel: DataFrame, val_days: int = VAL_DAYS) -> DataFrame:
    """Scores of persistence and trend: on validation rows, and at three horizons.

    Each horizon holds out its last days, forecasts them from the rest and joins by
    date, so forecasts are only ever compared with the same days. Both forecasts come from one cut of
    the histories and meet the actuals in one join.
    """
    one_step = naive_predictions(panel, val_days, {"persistence": "lag_1"})
    split = panel.withColumn("cutoff", cutoff_date(panel, val_days))
    trend = trend_fitted(split, fit_rows=F.col("date") <= F.col("cutoff"))
    trend_val = trend.where(F.col("date") > cutoff_date(panel, val_days)).select(*one_step.columns)
    historical = combine(one_step, trend_val).withColumn("horizon", F.lit("Historical"))
    ahead = backtest(panel, BACKTEST_HORIZONS, hold_and_extend)
    return score(combine(historical, ahead.select(*historical.columns)), ("model", "horizon"))


def backtest_matrix(panel: DataFrame, val_days: int = VAL_DAYS) -> DataFrame:
    return horizon_matrix(backtest_scores(panel, val_days))
