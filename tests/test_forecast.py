import datetime as dt
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfcast.operators import forecast, scoring


def test_trend_fixture_and_path(make_panel):
    panel = make_panel({(1, 1): [1, 3, 4]})
    row = forecast.fit_trend(panel).first()
    assert (row.slope, row.intercept, row.r_squared) == pytest.approx((1.5, 1.166667, 0.964286), abs=1e-6)
    path = forecast.trend_path(panel, 2).orderBy("date").collect()
    assert [r.yhat for r in path] == pytest.approx([1.166667 + 1.5 * t for t in range(5)], abs=1e-6)
    assert [r.kind for r in path] == ["fitted"] * 3 + ["forecast"] * 2
    assert path[-1].date == dt.date(2022, 1, 5)


def test_persistence_repeats_the_last_prediction(spark):
    rows = [("m", 1, 1, dt.date(2022, 1, d), 1.0, float(d)) for d in (1, 3, 2)]
    predictions = spark.createDataFrame(rows, "model string, store int, item int, date date, y double, yhat double")
    out = forecast.persistence(predictions, F.lit(dt.date(2022, 1, 10)), 4).orderBy("step").collect()
    assert [(r.step, r.yhat) for r in out] == [(s, 3.0) for s in (1, 2, 3, 4)]
    assert out[0].date == dt.date(2022, 1, 11)


def test_recursive_forecast_equals_a_loop(make_panel):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    panel = make_panel({(1, 1): values, (2, 2): [7, 7]})
    weights, base = [0.2, -0.1, 0.5], 0.7
    out = forecast.recursive_forecast(forecast.latest_sequence(panel, 3), weights, base, 12).orderBy("step").collect()
    window, expected = values[-3:], []
    for _ in range(12):
        expected.append(base + float(np.dot(weights, window)))
        window = window[1:] + [expected[-1]]
    assert [r.yhat for r in out] == pytest.approx(expected)
    assert {r.store for r in out} == {1} and out[-1].date == dt.date(2022, 1, 20)


def smooth_one(x, steps, grid, m=7):
    best = None
    for alpha, beta, gamma in grid:
        level = sum(x[:m]) / m
        trend = (sum(x[m : 2 * m]) / m - level) / m
        season = [v - level for v in x[:m]]
        fitted = []
        for t, value in enumerate(x):
            fitted.append(level + trend + season[t % m])
            new_level = alpha * (value - season[t % m]) + (1 - alpha) * (level + trend)
            new_season = gamma * (value - level - trend) + (1 - gamma) * season[t % m]
            trend = beta * (new_level - level) + (1 - beta) * trend
            level, season[t % m] = new_level, new_season
        sse = sum((a - b) ** 2 for a, b in zip(x, fitted))
        if best is None or sse < best[0]:
            ahead = [level + h * trend + season[(len(x) + h - 1) % m] for h in range(1, steps + 1)]
            best = (sse, fitted + ahead)
    return best[1]


def test_seasonal_smoothing_against_a_plain_loop(make_panel):
    rng = random.Random(2)
    x = [20 + t // 5 + 6 * (t % 7 == 5) + rng.randint(0, 3) for t in range(45)]
    panel = make_panel({(1, 1): x, (2, 2): [1] * 10})
    out = forecast.seasonal_smoothing(panel, 9).orderBy("date").collect()
    assert {r.store for r in out} == {1}
    assert [r.yhat for r in out] == pytest.approx(smooth_one([float(v) for v in x], 9, forecast.SMOOTHING_GRID))


def test_smoothing_recovers_a_perfect_season(make_panel):
    x = [10 + 2 * (t % 7) for t in range(35)]
    out = forecast.seasonal_smoothing(make_panel({(1, 1): x}), 7, grid=list(itertools.product((0.3,), (0.1,), (0.2,))))
    ahead = [r.yhat for r in out.where("kind = 'forecast'").orderBy("step").collect()]
    assert ahead == pytest.approx([10 + 2 * ((35 + h) % 7) for h in range(7)])


def test_backtest_only_compares_equal_dates(make_panel):
    panel = make_panel({(1, 1): list(range(40)), (2, 2): [5] * 8})
    rows = forecast.backtest(panel, {"short": 5, "long": 20}, forecast.hold_last).collect()
    assert {(r.horizon, r.store) for r in rows} == {("short", 1), ("long", 1), ("short", 2)}
    short = sorted((r.step, r.y, r.yhat) for r in rows if r.horizon == "short" and r.store == 1)
    assert short == [(s, 34.0 + s, 34.0) for s in range(1, 6)]
    trend = forecast.backtest(panel, {"short": 5}, forecast.extend_trend).where("store = 1").collect()
    assert all(r.yhat == pytest.approx(r.y) for r in trend)


def predictions(spark, rows):
    full = [(m, 1, 1, dt.date(2022, 1, 1) + dt.timedelta(days=i), float(y), float(p)) for m, i, y, p in rows]
    return spark.createDataFrame(full, "model string, store int, item int, date date, y double, yhat double")


def test_ranking_best_and_common_keys(spark):
    table = predictions(spark, [("a", 0, 1, 2), ("a", 1, 3, 3), ("a", 2, 5, 9), ("b", 0, 1, 1), ("b", 1, 3, 5)])
    common = scoring.on_common_keys(table, 2)
    assert common.count() == 4
    ranked = scoring.rank_models(scoring.score(common)).collect()
    assert [(r.model, r["rank"]) for r in ranked] == [("a", 1), ("b", 2)]
    best = {r.metric: r.model for r in scoring.best_per_metric(scoring.score(common)).collect()}
    assert best == {"rmse": "a", "mae": "a", "r2": "a", "mape": "b", "smape": "b"}


def test_horizon_matrix_leaves_missing_horizons_null(spark):
    scores = spark.createDataFrame([("a", "1 Month", 1.0, 2.0, 3.0, 4.0, 5.0)], "model string, horizon string, rmse double, mae double, r2 double, mape double, smape double")
    rows = {r.metric: r for r in scoring.horizon_matrix(scores).collect()}
    assert rows["mae"]["1 Month"] == 2.0 and rows["mae"]["1 Year"] is None


def test_macro_average_with_item_slice(spark):
    per_series = spark.createDataFrame([("a", "h", 1, 1, 10.0, 20.0), ("a", "h", 1, 2, 30.0, 40.0)], "model string, horizon string, store int, item int, mape double, smape double")
    row = scoring.macro_average(per_series, 1).first()
    assert (row.mape, row.mape_item, row.smape, row.smape_item, row.n_series) == (20, 10, 30, 20, 2)
    matrix = scoring.results_matrix(scoring.macro_average(per_series), ["h", "other"]).first()
    assert matrix["h_mape"] == 20 and matrix["other_smape"] is None


def errors_of(x, weights, m=7):
    """Sum of squared one-step errors under one set of weights, by a plain loop."""
    path = smooth_one(x, 1, [weights], m)
    return sum((a - b) ** 2 for a, b in zip(x, path))


def test_optimised_smoothing_never_errs_more_than_the_grid(make_panel):
    rng = random.Random(5)
    series = {
        (1, 1): [20 + t // 4 + 6 * (t % 7 == 5) + rng.randint(0, 3) for t in range(60)],
        (1, 2): [rng.randint(0, 9) for _ in range(41)],
        (2, 1): [10 + 2 * (t % 7) for t in range(35)],
        (2, 2): [1] * 10,
    }
    out = forecast.optimised_smoothing(make_panel(series), 9).orderBy("date").collect()
    assert {(r.store, r.item) for r in out} == set(series) - {(2, 2)}
    for key in set(series) - {(2, 2)}:
        x = [float(v) for v in series[key]]
        rows = [r for r in out if (r.store, r.item) == key]
        weights = (rows[0].alpha, rows[0].beta, rows[0].gamma)
        # Its own errors and path, by the loop, under the weights it names.
        assert rows[0].sse == pytest.approx(errors_of(x, weights), rel=1e-9, abs=1e-12)
        assert [r.yhat for r in rows] == pytest.approx(smooth_one(x, 9, [weights]))
        grid = min(errors_of(x, point) for point in forecast.SMOOTHING_GRID)
        assert rows[0].sse <= grid and (key == (2, 1) or rows[0].sse < grid)
        # No single step of the last size makes it better.
        size = forecast.DESCENT_STEP / 2 ** (forecast.DESCENT_HALVINGS - 1)
        for k in range(3):
            for move in (-size, size):
                near = [min(max(w + move * (i == k), 0.001), 0.999) for i, w in enumerate(weights)]
                assert errors_of(x, near) >= rows[0].sse * (1 - 1e-9) - 1e-12


def test_optimised_smoothing_does_not_depend_on_its_groups(make_panel, monkeypatch):
    rng = random.Random(8)
    panel = make_panel({(s, i): [rng.randint(0, 30) + 5 * (t % 7) for t in range(30 + 3 * s)] for s in range(3) for i in range(3)})
    rows = lambda: sorted(map(tuple, forecast.optimised_smoothing(panel, 3).collect()), key=str)
    together = rows()
    monkeypatch.setattr(forecast, "SERIES_SIDE_BY_SIDE", 2)
    assert rows() == together and len(together) == sum(33 + 3 * s for s in range(3)) * 3


def test_both_forecasters_from_one_history_equal_each_alone(make_panel):
    panel = make_panel({(1, 1): [3, 1, 4, 1, 5, 9, 2, 6] * 4, (2, 2): [5] * 8})
    horizons = {"short": 5, "long": 20}
    both = sorted(map(tuple, forecast.backtest(panel, horizons, forecast.hold_and_extend).select("model", "horizon", "store", "item", "date", "step", "y", "yhat").collect()))
    alone = [t for f in (forecast.hold_last, forecast.extend_trend) for t in map(tuple, forecast.backtest(panel, horizons, f).select("model", "horizon", "store", "item", "date", "step", "y", "yhat").collect())]
    assert both == sorted(alone) and len(both) == 60
