"""The global study: features, time split, regressors, ranking, stored results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import SERIES
from shelfcast.operators import regressors
from shelfcast.operators.codes import with_category_codes
from shelfcast.operators.features import FEATURES, LAGS, complete_rows, feature_frame, lookback_sequences, with_lags
from shelfcast.operators.forecast import persistence
from shelfcast.operators.scoring import best_per_metric, combine, long_predictions, rank_models, score, score_trailing, timeline_summary
from shelfcast.operators.splits import VAL_DAYS, pick_pair, rows_of, with_time_split
from shelfcast.session import materialize
from shelfcast.sources import results

SEQUENCE_MODEL = "SequenceBoosting"

# Forecasts that need no fit: each uses one feature column as the prediction.
NAIVE_MODELS = {
    "last_row": "lag_1",
    "row_7_back": "lag_7",
    "row_28_back": "lag_28",
    "mean_of_7": "roll_mean_7",
    "mean_of_28": "roll_mean_28",
}


def training_frame(panel: DataFrame) -> DataFrame:
    """All features of the complete rows. Codes are assigned after incomplete rows are
    dropped, and the original keys stay.

    The panel is written down first, so that its joins over the raw rows run once. The
    labels come from the series that keep a row, which is stored for both code tables.
    """
    panel = materialize(panel, "panel")
    return with_category_codes(complete_rows(feature_frame(panel)), SERIES, labels_from=_kept_series(panel))


def _kept_series(panel: DataFrame) -> DataFrame:
    """The series that keep a row when incomplete ones are dropped.

    Where no value is NULL these are the series longer than the longest lag, which a
    count with partial sums tells; else the lags themselves are asked.
    """
    counts = panel.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count_if(F.col("sales").isNull()).alias("gaps"))
    counts = materialize(counts, "series-counts")
    if counts.where("gaps > 0").isEmpty():
        return counts.where(F.col("n") > max(LAGS)).select(*SERIES)
    return materialize(complete_rows(with_lags(panel)).select(*SERIES).distinct(), "kept-series")


def naive_predictions(panel: DataFrame, val_days: int = VAL_DAYS, models: Mapping[str, str] = NAIVE_MODELS) -> DataFrame:
    """Validation rows with one prediction per naive model."""
    split = with_time_split(complete_rows(feature_frame(panel)), val_days)
    return long_predictions(split.where("split = 'val'"), models)


def chosen_pair_frame(panel: DataFrame, val_days: int = VAL_DAYS) -> DataFrame:
    """The validation rows, with features and codes, of one series: the wanted pair of codes or its fallback.

    The choice needs only how many complete rows each series has after the cutoff; features are made for the chosen
    series alone.
    """
    complete = with_time_split(complete_rows(with_lags(panel)), val_days)
    counts = complete.where("split = 'val'").groupBy(*SERIES, "cutoff").agg(F.count("*").alias("n_rows"))
    coded = with_category_codes(counts, SERIES, labels_from=_kept_series(panel))
    pair = materialize(pick_pair(coded), "chosen-pair").drop("n_rows")
    frame = complete_rows(feature_frame(rows_of(panel, pair)))
    return frame.join(F.broadcast(pair), list(SERIES)).where(F.col("date") > F.col("cutoff"))  # one row


@dataclass
class Study:
    """Tables of one run. When it was answered from stored metrics, predictions are those of the stored models, made anew."""

    tabular: DataFrame
    sequence: DataFrame
    ranking: DataFrame
    predictions: DataFrame
    from_cache: bool
    by_window: DataFrame
    timeline: DataFrame
    best: DataFrame
    forecasts: DataFrame


def tables_of(predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of fitted models: metrics by trailing window, summary by series, best model by metric, and the newest prediction held for a year."""
    last = predictions.agg(F.max("date")).scalar()
    return score_trailing(predictions), timeline_summary(predictions), best_per_metric(score(predictions)), persistence(predictions, last)


def stored_frame(panel: DataFrame, root: str, val_days: int) -> DataFrame:
    """Write the split training frame once and read it back.

    Every fit, scaler and scoring pass then reads only its columns from Parquet rather
    than repeating the windows, and a lost executor costs a re-read. The rows are
    written in the partitioning that the windows left, without another shuffle.
    """
    path = f"{root}/training_frame"
    frame = with_time_split(training_frame(panel), val_days)
    frame.write.mode("overwrite").parquet(path)
    return panel.sparkSession.read.schema(frame.schema).parquet(path)


def study_root(panel: DataFrame, base: str, val_days: int) -> str:
    """Folder of a study: another feature set, panel or hold-out has another one."""
    root = results.output_root(panel.sparkSession, base, FEATURES)
    return f"{root}/data_{results.data_fingerprint(panel)}_hold_{val_days}"


def run(
    panel: DataFrame,
    base: str,
    val_days: int = VAL_DAYS,
    estimators: Mapping[str, Estimator] | None = None,
    sequence_estimator: Estimator | None = None,
    retrain: bool = False,
    force: bool = False,
) -> Study:
    """Fit, score, rank and store.

    Stored metrics are returned as they are, unless ``force``, if they come from the same panel, hold-out, features and
    estimators; models fitted before are loaded on the same condition, unless ``retrain``.
    """
    spark = panel.sparkSession
    estimators = estimators or {name: make() for name, make in regressors.REGRESSORS.items()}
    sequence_estimator = sequence_estimator or regressors.sequence_boosting()
    data_root = study_root(panel, base, val_days)
    names = [regressors.stored_name(name, e) for name, e in {**estimators, SEQUENCE_MODEL: sequence_estimator}.items()]
    root = f"{data_root}/models_{results.feature_digest(names)}"
    if not (force or retrain):
        tables = results.read_all_metrics(spark, root)
        if tables is not None:
            tabular, everything, sequence = (tables[name] for name in results.RESULT_TABLES)
            predictions = predict_again(panel, base, val_days, estimators, sequence_estimator)
            return Study(tabular, sequence, rank_models(everything), predictions, True, *tables_of(predictions))

    split = stored_frame(panel, data_root, val_days)
    tabular_predictions, _ = regressors.fit_all(split, estimators, root=data_root, retrain=retrain)

    samples = lookback_sequences(split)
    sequence_predictions, model, scaler = regressors.fit_sequence_model(
        samples, sequence_estimator, SEQUENCE_MODEL
    )
    results.save_model(model, data_root, names[-1])
    results.save_scaler(scaler, data_root, names[-1])

    tables = dict(zip(("tabular", "all", "sequence"), results.RESULT_TABLES))
    results.write_metrics(score(tabular_predictions), root, tables["tabular"])
    results.write_metrics(score(sequence_predictions), root, tables["sequence"])
    tabular = results.read_metrics(spark, root, tables["tabular"])
    sequence = results.read_metrics(spark, root, tables["sequence"])
    ranking = rank_models(combine(tabular, sequence))
    results.write_metrics(ranking.drop("rank"), root, tables["all"])
    predictions = materialize(combine(tabular_predictions, sequence_predictions), "predictions")
    return Study(tabular, sequence, ranking, predictions, False, *tables_of(predictions))


def predict_again(
    panel: DataFrame,
    base: str,
    val_days: int = VAL_DAYS,
    estimators: Mapping[str, Estimator] | None = None,
    sequence_estimator: Estimator | None = None,
) -> DataFrame:
    """Validation predictions of the stored models, the sequence model with its scaler among them, without fitting anything."""
    spark = panel.sparkSession
    root = study_root(panel, base, val_days)
    frame = spark.read.parquet(f"{root}/training_frame")
    split = regressors.with_label(frame).where("split = 'val'")
    estimators = estimators or {name: make() for name, make in regressors.REGRESSORS.items()}
    parts = []
    for name, estimator in estimators.items():
        model = results.load_model(spark, root, regressors.stored_name(name, estimator))
        if model is not None:
            parts.append(regressors.predict(model, split, name))
    kept = regressors.stored_name(SEQUENCE_MODEL, sequence_estimator or regressors.sequence_boosting())
    model, scaler = results.load_model(spark, root, kept), results.load_scaler(spark, root, kept)
    if model is not None and scaler is not None:
        samples = lookback_sequences(frame).where("split = 'val'")
        parts.append(regressors.predict_sequences(model, scaler.first(), samples, SEQUENCE_MODEL))
    return combine(*parts)
