import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfcast.operators import regressors
from shelfcast.operators.features import FEATURES, complete_rows, lookback_sequences, with_lags
from shelfcast.operators.scoring import score
from shelfcast.operators.series_models import RIDGE_PENALTIES, chosen_penalty_ridge, per_series_ridge
from shelfcast.operators.splits import with_time_split
from shelfcast.plans import horizon_study, training_run


def signal(n, phase):
    return [int(60 + 25 * math.sin(2 * math.pi * (t + phase) / 7) + (t * 37 + phase * 11) % 5) for t in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    import datetime as dt

    rows = [
        (dt.date(2022, 1, 1) + dt.timedelta(days=t), s, i, v)
        for s in (1, 2)
        for i in (1, 2)
        for t, v in enumerate(signal(260, 2 * s + i))
    ]
    return spark.createDataFrame(rows, "date date, store int, item int, sales bigint").repartition(4)


@pytest.fixture(scope="module")
def split(panel, tmp_path_factory):
    return training_run.stored_frame(panel, str(tmp_path_factory.mktemp("frame")), 60)


SMALL = {
    "LinearRegression": lambda: regressors.linear_regression(),
    "DecisionTree": lambda: regressors.decision_tree(6),
    "RandomForest": lambda: regressors.random_forest(4, 6),
    "ExtraTrees": lambda: regressors.extra_trees(4, 6),
    "GradientBoosting": lambda: regressors.gradient_boosting(30),
    "HistGradientBoosting": lambda: regressors.hist_gradient_boosting(30, 4),
}


def test_all_regressors_beat_the_mean(split):
    predictions, fitted = regressors.fit_all(split, {name: make() for name, make in SMALL.items()})
    assert set(fitted) == set(SMALL) == set(regressors.REGRESSORS)
    n_val = split.where("split = 'val'").count()
    for row in score(predictions).join(predictions.groupBy("model").count(), "model").collect():
        assert row["count"] == n_val and row.r2 > 0.3, row


def test_defaults_are_the_full_sizes():
    trees = {name: make() for name, make in regressors.REGRESSORS.items()}
    assert (trees["RandomForest"].getTrees(), trees["RandomForest"].getMaxDepth()) == (200, 12)
    assert (trees["ExtraTrees"].getTrees(), trees["ExtraTrees"].getMaxDepth()) == (300, 12)
    assert (trees["GradientBoosting"].getTrees(), trees["GradientBoosting"].getRate(), trees["GradientBoosting"].getMaxDepth()) == (600, 0.05, 3)
    assert (trees["HistGradientBoosting"].getTrees(), trees["HistGradientBoosting"].getMaxDepth()) == (600, 12)
    assert trees["DecisionTree"].getMaxDepth() == 10
    assert all(m.getSeed() == 42 for name, m in trees.items() if name != "LinearRegression")


def test_linear_regression_is_least_squares(panel):
    split = with_time_split(complete_rows(with_lags(panel)), 60)
    predictions, _ = regressors.fit_all(split, {"LR": regressors.linear_regression()}, ["lag_1", "lag_7"])
    rows = split.select("split", "sales", "lag_1", "lag_7", "store", "item", "date").collect()
    design = lambda part: np.array([[1, r.lag_1, r.lag_7] for r in rows if r.split == part], float)
    y = np.array([r.sales for r in rows if r.split == "train"], float)
    weights = np.linalg.lstsq(design("train"), y, rcond=None)[0]
    expected = {(r.store, r.item, r.date): e for r, e in zip([r for r in rows if r.split == "val"], design("val") @ weights)}
    for r in predictions.collect():
        assert r.yhat == pytest.approx(expected[r.store, r.item, r.date], rel=1e-6)


def test_sequence_models_return_units_sold(split):
    samples = lookback_sequences(split)
    for name, estimator in (("huber", regressors.huber_regression()), ("boost", regressors.gradient_boosting(20))):
        predictions, _, scaler = regressors.fit_sequence_model(samples, estimator, name)
        row = score(predictions).first()
        assert row.r2 > 0.3 and scaler.count() == 1
        assert predictions.count() == samples.where("split = 'val'").count() > 0
        assert predictions.agg(F.min("y")).first()[0] > 30


def test_direct_models_learn_only_from_past_targets(split):
    horizons = {"near": 7, "far": 30}
    targeted = regressors.with_direct_targets(split, horizons)
    cutoff = split.first().cutoff
    assert targeted.where("part = 'train'").agg(F.max("target_date")).first()[0] <= cutoff
    by_day = {(r.store, r.item, r.date): r.sales for r in split.collect()}
    predictions = regressors.fit_direct(targeted, regressors.gradient_boosting(20), horizons, "direct")
    rows = predictions.collect()
    assert {r.horizon for r in rows} == set(horizons) and all(r.date > cutoff for r in rows)
    assert all(by_day[r.store, r.item, r.date] == r.y for r in rows)
    assert all(r.r2 > 0.3 for r in score(predictions, ("horizon",)).collect())


def test_early_stopping_uses_the_end_of_training(split):
    train = split.where("split = 'train'")
    marked = regressors.with_early_stop_rows(train, 30)
    last = train.agg(F.max("date")).first()[0]
    stop = marked.where("stop_row").agg(F.min("date"), F.max("date")).first()
    assert (last - stop[0]).days == 29 and stop[1] == last
    predictions, model = regressors.fit_with_early_stop(split, regressors.early_stopping_boosting(60, 3), "early", days=30)
    assert model.stages[-1].trees <= 60 and score(predictions).first().r2 > 0.3


def test_per_series_ridge_against_brute_force(spark, panel):
    horizons = {"near": 3, "far": 10}
    frame = horizon_study.study_frame(panel).drop("holiday").withColumn("holiday", F.lit(0))
    got = per_series_ridge(frame, 5, horizons, min_windows=20)
    rows = {(r.store, r.item, r.horizon, r.anchor_date): (r.y, r.yhat) for r in got.collect()}
    series = sorted(((r.date, r.sales, r.day_of_week, r.month) for r in frame.where("store = 1 and item = 2").collect()))
    data = np.array([[s, d, m, 0] for _, s, d, m in series], float)
    for name, h in horizons.items():
        n = len(data) - 5 - h + 1
        n_train, first_test = int(n * 0.7), int(n * 0.85)
        low, high = data[: n_train + 4].min(axis=0), data[: n_train + 4].max(axis=0)
        unit = (data - low) / np.where(high > low, high - low, 1)
        # A window lists each input's five values in turn.
        x = np.array([unit[i : i + 5].T.ravel() for i in range(n)])
        y = np.array([data[i + 5 + h - 1, 0] for i in range(n)])
        centre, level = x[:n_train].mean(axis=0), y[:n_train].mean()
        z = x[:n_train] - centre
        w = np.linalg.inv(z.T @ z + np.eye(z.shape[1])) @ z.T @ (y[:n_train] - level)
        mine = {k: v for k, v in rows.items() if k[:3] == (1, 2, name)}
        assert len(mine) == n - first_test
        for i in range(first_test, n):
            assert mine[1, 2, name, series[i + 4][0]] == pytest.approx((y[i], (x[i] - centre) @ w + level))


def test_short_series_give_no_ridge_rows(make_panel):
    frame = horizon_study.study_frame(make_panel({(1, 1): [1] * 20}))
    assert per_series_ridge(frame).count() == 0


def test_run_store_and_reuse(panel, tmp_path):
    small = {name: SMALL[name]() for name in ("LinearRegression", "DecisionTree")}
    first = training_run.run(panel, str(tmp_path), 60, small, regressors.gradient_boosting(5))
    assert not first.from_cache and first.predictions.count() > 0
    ranked = first.ranking.collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and [r.rmse for r in ranked] == sorted(r.rmse for r in ranked)
    models = {"LinearRegression", "DecisionTree", training_run.SEQUENCE_MODEL}
    assert {r.model for r in first.by_window.collect()} == models == {r.model for r in first.timeline.collect()}
    assert {r.metric for r in first.best.collect()} == {"rmse", "mae", "r2", "mape", "smape"}
    steps = first.forecasts.groupBy("model", "store", "item").agg(F.max("step").alias("n")).collect()
    assert {r.model for r in steps} == models and {r.n for r in steps} == {365}
    again = training_run.run(panel, str(tmp_path), 60, small, regressors.gradient_boosting(5))
    assert again.from_cache and [r.model for r in again.ranking.collect()] == [r.model for r in ranked]
    # A run answered from stored metrics has its forecasts from the stored models.
    last = lambda study: {(r.model, r.store, r.item, r.step): r.yhat for r in study.forecasts.collect()}
    assert last(again) == pytest.approx(last(first)) and again.timeline.count() == first.timeline.count()
    repeated = score(training_run.predict_again(panel, str(tmp_path), 60, small, regressors.gradient_boosting(5)))
    before = {r.model: r.rmse for r in ranked}
    assert {r.model: r.rmse for r in repeated.collect()} == pytest.approx(before)


def test_stored_results_answer_for_what_made_them_only(panel, tmp_path):
    small = {"LinearRegression": regressors.linear_regression()}
    run = lambda p, days, models, rounds=2: training_run.run(p, str(tmp_path), days, models, regressors.gradient_boosting(rounds))
    assert not run(panel, 60, small).from_cache and run(panel, 60, small).from_cache
    for other in (
        lambda: run(panel.where("store = 1"), 60, small),
        lambda: run(panel, 50, small),
        lambda: run(panel, 60, {"LinearRegression": regressors.linear_regression(fitIntercept=False)}),
        lambda: run(panel, 60, small, 3),
    ):
        assert not other().from_cache
    assert run(panel, 60, small).from_cache


def test_horizon_study_runs_on_long_series(make_panel):
    frame = make_panel({(1, 1): signal(560, 1), (1, 2): signal(560, 4), (2, 2): signal(100, 0)})
    macro, matrix = horizon_study.run(frame, item=1)
    by_key = {(r.model, r.horizon): r for r in macro.collect()}
    assert set(m for m, _ in by_key) == {"per_series_ridge", "last_value", "window_mean"}
    assert by_key["per_series_ridge", "1 month"].n_series == 2
    assert by_key["per_series_ridge", "1 month"].mape < by_key["window_mean", "1 month"].mape
    assert matrix.count() == 3
    assert len(FEATURES) == 27


def test_penalty_is_the_best_one_on_the_validation_windows(panel):
    horizons = {"near": 3}
    frame = horizon_study.study_frame(panel).drop("holiday").withColumn("holiday", F.lit(0))
    got = chosen_penalty_ridge(frame, 5, horizons, min_windows=20)
    rows = {r.anchor_date: (r.yhat, r.penalty) for r in got.where("store = 2 and item = 1").collect()}
    series = sorted(((r.date, r.sales, r.day_of_week, r.month) for r in frame.where("store = 2 and item = 1").collect()))
    data = np.array([[s, d, m, 0] for _, s, d, m in series], float)
    n = len(data) - 5 - 3 + 1
    n_train, first_test = int(n * 0.7), int(n * 0.85)
    low, high = data[: n_train + 4].min(axis=0), data[: n_train + 4].max(axis=0)
    unit = (data - low) / np.where(high > low, high - low, 1)
    x = np.array([unit[i : i + 5].T.ravel() for i in range(n)])
    y = np.array([data[i + 7, 0] for i in range(n)])
    centre, level = x[:n_train].mean(axis=0), y[:n_train].mean()
    z = x[:n_train] - centre
    guesses = {}
    for penalty in RIDGE_PENALTIES:
        # Least squares of the smallest weights where nothing is penalised, as constant inputs leave some open.
        w = np.linalg.pinv(z.T @ z + penalty * np.eye(z.shape[1]), rcond=1e-10) @ z.T @ (y[:n_train] - level)
        guesses[penalty] = (x - centre) @ w + level
    best = min(RIDGE_PENALTIES, key=lambda p: ((guesses[p] - y)[n_train:first_test] ** 2).sum())
    assert {p for _, p in rows.values()} == {best} and len(rows) == n - first_test
    for i in range(first_test, n):
        assert rows[series[i + 4][0]][0] == pytest.approx(guesses[best][i], rel=1e-6)


def test_recursive_sequences_equal_a_loop(split):
    """Lines and trees: each step sees the steps before it, and the last row's features, scaled as for the fit."""
    features = ["dow", "month"]
    samples = lookback_sequences(split, 4)
    for name, estimator in (("line", regressors.linear_regression()), ("trees", regressors.gradient_boosting(5))):
        _, model, scaler = regressors.fit_sequence_model(samples, estimator, name, features, 4)
        p = scaler.first()
        found = {(r.store, r.item, r.step): r.yhat for r in regressors.recursive_sequence_forecast(split, model, p, name, features, 4, 6).collect()}
        assert len(found) == 4 * 6
        rows = sorted((r for r in split.where("store = 1 and item = 2").collect()), key=lambda r: r.date)
        window, fixed = [float(r.sales) for r in rows[-4:]], [(rows[-1][f] - p[f"{f}_mean"]) / p[f"{f}_std"] for f in features]
        fitted = model.stages[-1]
        for step in range(1, 7):
            inputs = np.array([*window, *fixed])
            z = float(fitted.ensemble.predict(inputs[None])[0]) if name == "trees" else float(fitted.intercept + np.dot(fitted.coefficients, inputs))
            window = [*window[1:], z * p.y_std + p.y_mean]
            assert found[1, 2, step] == pytest.approx(window[-1], rel=1e-9)


def test_fits_run_at_the_same_time_and_keep_their_names(split):
    import threading

    meet = threading.Barrier(3, timeout=60)

    class Waiting:
        def __init__(self, name):
            self.name = name

        def __call__(self):
            meet.wait()  # Only passes if all three fits run at once.
            return self.name

    found = regressors.fit_together(split.sparkSession, {name: Waiting(name) for name in "abc"})
    assert found == {"a": "a", "b": "b", "c": "c"}


def test_chosen_pair_is_the_one_of_all_features(panel):
    from shelfcast.operators import splits

    whole = with_time_split(training_run.training_frame(panel), 60).where("split = 'val'")
    expected = splits.rows_of(whole, splits.choose_pair(whole)).drop("split").collect()
    found = training_run.chosen_pair_frame(panel, 60)
    assert sorted(r.asDict().items() for r in found.select(expected[0].__fields__).collect()) == sorted(r.asDict().items() for r in expected)


def test_boosting_starts_before_forests_and_lines(spark, monkeypatch):
    """Its rounds wait for each other, so it would otherwise be what all cores wait for at the end."""
    rows = spark.createDataFrame([("2022-01-01", 1, 1, 5, 1.0, "train")], "date string, store int, item int, sales long, lag_1 double, split string")
    order = []

    class Started(Exception):
        pass

    def started(_, fits):
        order.extend(fits)
        raise Started

    monkeypatch.setattr(regressors, "fit_together", started)
    with pytest.raises(Started):
        regressors.fit_all(rows, {name: make() for name, make in SMALL.items()}, ["lag_1"])
    assert order[:2] == ["GradientBoosting", "HistGradientBoosting"] and set(order) == set(SMALL)
