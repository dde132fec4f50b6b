"""Regressors on the feature frame: fit, predict with keys, store and reload.

Lines and the single tree are Spark ML's; forests and boosting are those of :mod:`shelfcast.operators.trees`. Fits
that don't depend on each other run at the same time. Predictions keep ``store, item, date``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfcast import SERIES, SERIES_DAY
from shelfcast.operators.features import BY_DATE, FEATURES, LOOKBACK
from shelfcast.operators.forecast import LONGEST, latest_sequence, recursive_forecast
from shelfcast.operators.scaling import fit_standard, scale_standard, unscale_standard
from shelfcast.operators.scoring import combine
from shelfcast.operators.trees import BOOSTING, FOREST, RANDOM, TreeEnsembleModel, TreeEnsembleRegressor
from shelfcast.session import materialize, shared_dir
from shelfcast.sources.results import estimator_fingerprint, feature_digest, load_model, save_model

# Seed, and size and depth of the models.
SEED = 42
TREE_DEPTH = 10
FOREST_TREES = 200
FOREST_DEPTH = 12
EXTRA_TREES = 300
BOOST_ROUNDS = 600
BOOST_DEPTH = 3
BOOST_RATE = 0.05
BOOST_SUBSAMPLE = 0.9
HIST_BOOST_DEPTH = 12
HIST_BOOST_ROWS = 20
HIST_BOOST_LEAVES = 31
HIST_BOOST_PENALTY = 1.0
PATIENCE = 15
# Candidate thresholds of every tree model; the most that fit one byte.
BINS = 256
# Independent fits that run at a time. Each submits its own jobs, which share the cluster.
FITS_AT_ONCE = 4

_COLUMNS = {"featuresCol": "features", "labelCol": "y", "predictionCol": "yhat"}


def linear_regression(**extra) -> LinearRegression:
    return LinearRegression(**_COLUMNS, solver="normal", regParam=0.0, **extra)


def decision_tree(depth: int = TREE_DEPTH) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(**_COLUMNS, maxDepth=depth, maxBins=BINS, seed=SEED)


def random_forest(trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> TreeEnsembleRegressor:
    """Every tree sees a bag of the rows, and every node all inputs."""
    return TreeEnsembleRegressor(**_COLUMNS, kind=FOREST, trees=trees, maxDepth=depth, bins=BINS, seed=SEED)


def extra_trees(trees: int = EXTRA_TREES, depth: int = FOREST_DEPTH) -> TreeEnsembleRegressor:
    """Every tree sees all rows; every node draws one threshold for each input and takes the best."""
    return TreeEnsembleRegressor(**_COLUMNS, kind=RANDOM, trees=trees, maxDepth=depth, bins=BINS, seed=SEED)


def gradient_boosting(rounds: int = BOOST_ROUNDS, depth: int = BOOST_DEPTH) -> TreeEnsembleRegressor:
    return TreeEnsembleRegressor(**_COLUMNS, kind=BOOSTING, trees=rounds, maxDepth=depth, rate=BOOST_RATE, share=BOOST_SUBSAMPLE, bins=BINS, seed=SEED)


def hist_gradient_boosting(rounds: int = BOOST_ROUNDS, depth: int = HIST_BOOST_DEPTH, penalty: float = HIST_BOOST_PENALTY) -> TreeEnsembleRegressor:
    """Boosting that grows each tree by its best leaf first, with an L2 penalty on leaves."""
    return TreeEnsembleRegressor(
        **_COLUMNS, kind=BOOSTING, trees=rounds, maxDepth=depth, rate=BOOST_RATE, penalty=penalty, leastRows=HIST_BOOST_ROWS, maxLeaves=HIST_BOOST_LEAVES,
        bins=BINS, seed=SEED,
    )


REGRESSORS: dict[str, Callable[[], Estimator]] = {
    "LinearRegression": linear_regression,
    "DecisionTree": decision_tree,
    "RandomForest": random_forest,
    "ExtraTrees": extra_trees,
    "GradientBoosting": gradient_boosting,
    "HistGradientBoosting": hist_gradient_boosting,
}


def with_label(frame: DataFrame, label: str = "sales") -> DataFrame:
    return frame.withColumn("y", F.col(label).cast("double"))


def as_pipeline(estimator: Estimator, features: Sequence[str] = FEATURES) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def predict(fitted: PipelineModel, frame: DataFrame, name: str) -> DataFrame:
    return fitted.transform(frame).select(F.lit(name).alias("model"), *SERIES_DAY, "y", "yhat")


def stored_name(name: str, estimator: Estimator, features: Sequence[str] = FEATURES) -> str:
    """Name under which a fitted model is kept: other parameters or inputs make another model."""
    return f"{name}-{estimator_fingerprint(estimator)}-{feature_digest(features)}"


def fit_together(spark: SparkSession, fits: Mapping[str, Callable[[], PipelineModel]]) -> dict[str, PipelineModel]:
    """Run independent fits at the same time, each in a scheduler pool of its own.

    The pools share the cluster evenly where the session's scheduler mode is FAIR; else jobs run as they come, and
    more fits than run at a time start in the order given.
    """

    def run(name: str) -> PipelineModel:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        return fits[name]()

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in fits}
        return {name: fit.result() for name, fit in running.items()}


def fit_all(
    split: DataFrame,
    estimators: Mapping[str, Estimator],
    features: Sequence[str] = FEATURES,
    root: str | None = None,
    retrain: bool = False,
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit (or reload from ``root``) each estimator on the training part.

    ``root`` must stand for the training rows, as ``training_run.study_root`` does. Returns the validation
    predictions of all models in one long table, and the models. The training part is kept in executor memory and on disk while they are fitted.
    """
    spark = split.sparkSession
    shared_dir(spark)
    labelled = with_label(split)
    # The keys tell otherwise equal rows apart where rows are drawn.
    train = labelled.where(F.col("split") == "train").select(*dict.fromkeys((*SERIES_DAY, *features, "y"))).persist()

    def fit(name: str, estimator: Estimator) -> PipelineModel:
        model = None if retrain or root is None else load_model(spark, root, stored_name(name, estimator, features))
        if model is None:
            model = as_pipeline(estimator, features).fit(train)
            if root is not None:
                save_model(model, root, stored_name(name, estimator, features))
        return model

    # Rounds of boosting wait for each other whatever the cores: they start first, and forests and lines run beside them.
    sequential = lambda e: isinstance(e, TreeEnsembleRegressor) and e.getOrDefault(e.kind) == BOOSTING
    order = sorted(estimators, key=lambda name: not sequential(estimators[name]))
    try:
        found = fit_together(spark, {name: lambda n=name: fit(n, estimators[n]) for name in order})
    finally:
        train.unpersist()
    fitted = {name: found[name] for name in estimators}
    held_out = labelled.where(F.col("split") == "val").select(*dict.fromkeys((*SERIES_DAY, *features, "y")))
    return combine(*(predict(model, held_out, name) for name, model in fitted.items())), fitted


def with_early_stop_rows(train: DataFrame, days: int = 60) -> DataFrame:
    """Mark the last ``days`` days of the training part as rows that only decide when to stop.

    The rows on which the model is reported take no part in that decision.
    """
    start = train.agg(F.date_sub(F.max("date"), days)).scalar()
    return train.withColumn("stop_start", start).withColumn("stop_row", F.col("date") > F.col("stop_start"))


def early_stopping_boosting(rounds: int = BOOST_ROUNDS, patience: int = PATIENCE, depth: int = BOOST_DEPTH) -> TreeEnsembleRegressor:
    """Boosting that ends ``patience`` rounds after the one with the smallest loss on the marked rows, and keeps the trees up to that one."""
    return TreeEnsembleRegressor(
        **_COLUMNS, kind=BOOSTING, trees=rounds, maxDepth=depth, rate=BOOST_RATE, share=BOOST_SUBSAMPLE, patience=patience, stopCol="stop_row", bins=BINS, seed=SEED
    )


def fit_with_early_stop(
    split: DataFrame, estimator: Estimator, name: str, features: Sequence[str] = FEATURES, days: int = 60
) -> tuple[DataFrame, PipelineModel]:
    labelled = with_label(split)
    train = with_early_stop_rows(labelled.where(F.col("split") == "train"), days)
    model = as_pipeline(estimator, features).fit(train.select(*dict.fromkeys((*SERIES_DAY, *features, "y", "stop_row"))))
    return predict(model, labelled.where(F.col("split") == "val"), name), model


def with_direct_targets(split: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """A row per horizon: ``y`` and ``target_date`` of the row h rows later in the series,
    and ``part``: 'train' when the target lies before the cutoff, else 'val'.

    A row whose target is in the training part is the only kind a model may learn
    from, whatever side of the cutoff the row itself is on.
    """
    targets = ", ".join(
        f"struct('{name}' AS horizon, lead(sales, {h}) OVER ({BY_DATE}) AS target, lead(date, {h}) OVER ({BY_DATE}) AS target_date)"
        for name, h in horizons.items()
    )
    return (
        split.withColumn("targets", F.expr(f"array({targets})"))
        .select(*split.columns, F.inline("targets"))
        .where(F.col("target").isNotNull())
        .withColumn("y", F.col("target").cast("double"))
        .withColumn("part", F.when(F.col("target_date") <= F.col("cutoff"), "train").otherwise("val"))
    )


def fit_direct(
    targeted: DataFrame, estimator: Estimator, horizons: Mapping[str, int], name: str, features: Sequence[str] = (*FEATURES, "sales")
) -> DataFrame:
    """One model per horizon, straight from today's features to the value h rows ahead.

    For tree models, whose forecasts cannot be fed back in closed form. ``date`` in the
    result is the date that was forecast. The rows are written once, apart by horizon,
    so each fit reads only its own. A horizon longer than every series has no row to
    learn from and no forecast.
    """
    columns = list(dict.fromkeys((*SERIES, "target_date", *features, "y", "part", "horizon")))
    stored = materialize(targeted.select(*columns), "direct-targets", ["horizon"])
    trainable = {r.horizon for r in stored.where("part = 'train'").select("horizon").distinct().collect()}
    empty = stored.where(F.lit(False)).select(
        F.lit(name).alias("model"), "horizon", *SERIES, F.col("target_date").alias("date"), "y", F.col("y").alias("yhat")
    )
    usable = [h for h in horizons if h in trainable]
    of = lambda horizon, part: stored.where((F.col("horizon") == horizon) & (F.col("part") == part))
    train = lambda horizon: of(horizon, "train").select(*dict.fromkeys((*SERIES, "target_date", *features, "y")))
    models = fit_together(targeted.sparkSession, {h: lambda h=h: as_pipeline(estimator, features).fit(train(h)) for h in usable})
    parts = [empty]
    for horizon, model in models.items():
        parts.append(
            model.transform(of(horizon, "val")).select(
                F.lit(name).alias("model"), "horizon", *SERIES, F.col("target_date").alias("date"), "y", "yhat"
            )
        )
    return combine(*parts)


def huber_regression() -> LinearRegression:
    """Linear model with the robust loss; Spark needs a threshold above 1."""
    return LinearRegression(**_COLUMNS, loss="huber", epsilon=1.35, maxIter=100, regParam=0.0)


def sequence_boosting(rounds: int = BOOST_ROUNDS) -> TreeEnsembleRegressor:
    return gradient_boosting(rounds)


def _sequence_inputs(part: DataFrame, parameters: Row, features: Sequence[str]) -> DataFrame:
    scaled = scale_standard(part.withColumn("actual", F.col("y").cast("double")), parameters, [*features, "y"])
    return scaled.withColumn("sequence", array_to_vector(F.transform("seq", lambda v: v.cast("double"))))


def predict_sequences(model: PipelineModel, parameters: Row, held_out: DataFrame, name: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Predictions in units sold from a fitted sequence model and its scaler's parameters."""
    scored = unscale_standard(model.transform(_sequence_inputs(held_out, parameters, features)), parameters, "yhat", "y")
    return scored.select(F.lit(name).alias("model"), *SERIES_DAY, F.col("actual").alias("y"), "yhat")


def fit_sequence_model(
    samples: DataFrame,
    estimator: Estimator,
    name: str,
    features: Sequence[str] = FEATURES,
    lookback: int = LOOKBACK,
) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """Regress on the lookback sequence plus the scaled features, with a scaled target.

    ``samples`` comes from ``lookback_sequences``; they are written once, for the scaler, the fit and the scoring. Scalers
    see training rows only. Returns predictions in units sold, the model and the scaler parameters.
    """
    columns = list(dict.fromkeys((*SERIES_DAY, "split", "seq", *features, "y")))
    samples = materialize(samples.select(*columns), "samples")
    train = samples.where(F.col("split") == "train")
    scaler = fit_standard(train, [*features, "y"])
    parameters = scaler.first()
    assembler = VectorAssembler(inputCols=["sequence", *features], outputCol="features")
    sized = VectorSizeHint(inputCol="sequence", size=lookback)
    model = Pipeline(stages=[sized, assembler, estimator]).fit(
        _sequence_inputs(train, parameters, features).select(*dict.fromkeys(("sequence", *SERIES_DAY, *features, "y")))
    )
    predictions = predict_sequences(model, parameters, samples.where(F.col("split") == "val"), name, features)
    return predictions, model, samples.sparkSession.createDataFrame([parameters], scaler.schema)


def recursive_sequence_forecast(
    frame: DataFrame,
    model: PipelineModel,
    parameters: Row,
    name: str,
    features: Sequence[str] = FEATURES,
    lookback: int = LOOKBACK,
    steps: int = LONGEST,
) -> DataFrame:
    """Feed a fitted sequence model its own predictions, ``steps`` days beyond each series' last row.

    ``frame``: complete rows; the features of the last one stay fixed, as scaled for the fit, while the sequence moves on. A line is rolled
    forward inside the JVM: its base is the intercept and the fixed terms, brought back to units sold. Other models predict a
    step for many series at a time. Series with fewer than ``lookback`` rows have no forecast.
    """
    last = frame.groupBy(*SERIES).agg(*(F.max_by(F.col(c).cast("double"), "date").alias(c) for c in features))
    latest = latest_sequence(frame, lookback).join(last, list(SERIES))
    fitted = model.stages[-1]
    if not isinstance(fitted, TreeEnsembleModel):
        weights, spread, centre = list(fitted.coefficients), parameters["y_std"], parameters["y_mean"]
        fixed = F.lit(float(fitted.intercept))
        for column, weight in zip(features, weights[lookback:]):
            fixed = fixed + F.lit(float(weight)) * (F.col(column) - parameters[f"{column}_mean"]) / parameters[f"{column}_std"]
        return recursive_forecast(latest, [w * spread for w in weights[:lookback]], fixed * spread + centre, steps, name)
    scaled = scale_standard(latest, parameters, features).select(*SERIES, "last_date", "seq", F.array(*features).alias("fixed"))
    sent = frame.sparkSession.sparkContext.broadcast((fitted.ensemble, parameters["y_mean"], parameters["y_std"]))

    def roll(batches):
        ensemble, centre, spread = sent.value
        for rows in batches:
            path = np.empty((len(rows), steps))
            if len(rows):
                ring, fixed = (np.array(rows[c].tolist(), float).reshape(len(rows), -1) for c in ("seq", "fixed"))
                for step in range(steps):
                    path[:, step] = ensemble.predict(np.hstack([ring, fixed])) * spread + centre
                    ring = np.hstack([ring[:, 1:], path[:, step, None]])
            yield rows[[*SERIES, "last_date"]].assign(path=list(path))

    keys = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in SERIES)
    paths = scaled.mapInPandas(roll, f"{keys}, last_date date, path array<double>").select(*SERIES, "last_date", F.posexplode("path").alias("step", "yhat"))
    return paths.select(
        F.lit(name).alias("model"), *SERIES, F.date_add("last_date", F.col("step") + 1).alias("date"), (F.col("step") + 1).alias("step"), "yhat"
    )
