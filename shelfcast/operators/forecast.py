"""Forecast paths: persistence, linear trend, seasonal smoothing, recursive linear models."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import SERIES, SERIES_DAY
from shelfcast.operators.features import whole_series, with_position
from shelfcast.operators.scoring import join_actuals

# Longest forecast in days and season length in rows.
LONGEST = 365
SEASON = 7

# Candidate smoothing weights for level, trend and season.
SMOOTHING_GRID = tuple(itertools.product((0.1, 0.3, 0.6), (0.01, 0.1, 0.3), (0.05, 0.2, 0.4)))


def future_days(series: DataFrame, steps: int | Column = LONGEST) -> DataFrame:
    """Each row once per future day: ``step`` 1..steps and ``date`` = ``last_date`` + step."""
    steps = steps if isinstance(steps, Column) else F.lit(steps)
    return series.withColumn("step", F.explode(F.sequence(F.lit(1), steps))).withColumn(
        "date", F.date_add("last_date", F.col("step"))
    )


def last_predictions(predictions: DataFrame) -> DataFrame:
    """The prediction at the last date of each model and series."""
    return predictions.groupBy("model", *SERIES).agg(F.max_by("yhat", "date").alias("yhat"))


def persistence(predictions: DataFrame, last_date: Column, steps: int = LONGEST) -> DataFrame:
    """Repeat each series' last prediction for ``steps`` days after ``last_date``.

    The first 30 and 90 steps are the shorter horizons.
    """
    held = last_predictions(predictions).withColumn("last_date", last_date)
    return future_days(held, steps).select("model", *SERIES_DAY, "step", "yhat")


def fit_line(placed: DataFrame, keys: Sequence[str] = SERIES, value: str = "sales") -> DataFrame:
    """Per key: least-squares line over the position ``t``; ``n_rows`` and ``last_date``."""
    return placed.groupBy(*keys).agg(
        F.regr_slope(value, "t").alias("slope"),
        F.regr_intercept(value, "t").alias("intercept"),
        F.regr_r2(value, "t").alias("r_squared"),
        F.count("*").alias("n_rows"),
        F.max("date").alias("last_date"),
    )


def fit_trend(panel: DataFrame, value: str = "sales") -> DataFrame:
    """The line of each series. The aggregation keeps the partitioning of the window before it."""
    return fit_line(with_position(panel), value=value)


def trend_forecast(trend: DataFrame, steps: int | Column = LONGEST, keys: Sequence[str] = SERIES) -> DataFrame:
    """The fitted line, continued."""
    line = F.col("intercept") + F.col("slope") * (F.col("n_rows") - 1 + F.col("step"))
    return future_days(trend, steps).select(F.lit("linear_trend").alias("model"), *keys, "date", "step", line.alias("yhat"))


def trend_fitted(panel: DataFrame, value: str = "sales", fit_rows: Column | None = None) -> DataFrame:
    """The line at each panel row, fitted on all rows or on those where ``fit_rows`` holds.

    The line is computed with windows, so there is no join.
    """
    x, t = F.col(value), F.col("t")
    if fit_rows is not None:
        x, t = F.when(fit_rows, x), F.when(fit_rows, t)
    placed = with_position(panel).withColumns(
        {"slope": F.regr_slope(x, t).over(whole_series()), "intercept": F.regr_intercept(x, t).over(whole_series())}
    )
    line = F.col("intercept") + F.col("slope") * F.col("t")
    return placed.select(F.lit("linear_trend").alias("model"), *SERIES_DAY, F.col(value).cast("double").alias("y"), line.alias("yhat"))


def fitted_and_forecast(fitted: DataFrame, forecast: DataFrame) -> DataFrame:
    """Both parts in one table with ``kind``; fitted rows have step 0."""
    head = fitted.withColumns({"kind": F.lit("fitted"), "step": F.lit(0)})
    return head.unionByName(forecast.withColumn("kind", F.lit("forecast")))


def trend_path(panel: DataFrame, steps: int = LONGEST) -> DataFrame:
    """Linear trend over the history and ``steps`` days beyond."""
    return fitted_and_forecast(trend_fitted(panel).drop("y"), trend_forecast(fit_trend(panel), steps))


def seasonal_smoothing(
    panel: DataFrame,
    steps: int = LONGEST,
    season: int = SEASON,
    grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID,
) -> DataFrame:
    """Additive level + trend + season smoothing: fitted values and ``steps`` forecasts.

    The weights are the grid point with the smallest sum of squared one-step errors,
    the first one on a tie. Start values come from the first two seasons, so a series
    shorter than that has no result. The recursion runs over time for all grid points
    at once; one group is one series, which is no longer than its days.
    """
    schema = "store {}, item {}, date date, step int, kind string, yhat double".format(
        *(panel.schema[c].dataType.simpleString() for c in SERIES)
    )
    weights = [tuple(map(float, point)) for point in grid]

    def smooth(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("date")
        x = rows["sales"].to_numpy(dtype=float)
        if len(x) < 2 * season:
            return pd.DataFrame(columns=["store", "item", "date", "step", "kind", "yhat"], dtype=object)
        alpha, beta, gamma = np.array(weights).T
        first, second = x[:season], x[season : 2 * season]
        level = np.full(len(alpha), first.mean())
        trend = np.full(len(alpha), (second - first).mean() / season)
        seasons = np.repeat((first - first.mean())[:, None], len(alpha), axis=1)
        fitted = np.empty((len(x), len(alpha)))
        for t, actual in enumerate(x):
            slot = t % season
            base = level + trend
            fitted[t] = base + seasons[slot]
            new_level = alpha * (actual - seasons[slot]) + (1 - alpha) * base
            trend = beta * (new_level - level) + (1 - beta) * trend
            seasons[slot] = gamma * (actual - base) + (1 - gamma) * seasons[slot]
            level = new_level
        best = int(np.argmin(((x[:, None] - fitted) ** 2).sum(axis=0)))
        ahead = np.arange(1, steps + 1)
        path = level[best] + trend[best] * ahead + seasons[(len(x) + ahead - 1) % season, best]
        last = pd.Timestamp(rows["date"].iloc[-1])
        return pd.DataFrame(
            {
                "store": rows["store"].iloc[0],
                "item": rows["item"].iloc[0],
                "date": [*rows["date"], *(last + pd.to_timedelta(ahead, unit="D")).date],
                "step": np.concatenate([np.zeros(len(x), dtype=int), ahead]),
                "kind": ["fitted"] * len(x) + ["forecast"] * steps,
                "yhat": np.concatenate([fitted[:, best], path]),
            }
        )

    return (
        panel.select(*SERIES_DAY, "sales")
        .groupBy(*SERIES)
        .applyInPandas(smooth, schema)
        .withColumn("model", F.lit("seasonal_smoothing"))
        .select("model", *SERIES_DAY, "step", "kind", "yhat")
    )


def latest_sequence(panel: DataFrame, length: int, value: str = "sales") -> DataFrame:
    """Per series: the last ``length`` values as ``seq`` (oldest first) and ``last_date``.

    Series with fewer rows have no sequence. ``sort_array`` runs on at most ``length``
    values, as older rows are filtered out by rank first.
    """
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    tail = panel.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= length)
    rows = F.sort_array(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v"))))
    return (
        tail.groupBy(*SERIES)
        .agg(F.transform(rows, lambda r: r["v"]).alias("seq"), F.max("date").alias("last_date"))
        .where(F.size("seq") == length)
    )


def recursive_forecast(
    sequences: DataFrame,
    weights: Sequence[float] | Column,
    base: float | Column,
    steps: int = LONGEST,
    model: str = "recursive_linear",
) -> DataFrame:
    """Feed each prediction back as the newest value, ``steps`` times.

    The prediction is ``base`` (intercept plus the terms that stay fixed) plus the dot
    product of ``weights`` with the latest values. Everything is a fold inside the
    JVM; its state is the latest values, as many as ``seq`` has, beside the path so far.
    """
    if not isinstance(weights, Column):
        weights = F.array(*(F.lit(float(w)) for w in weights))
    base = base if isinstance(base, Column) else F.lit(float(base))

    def extend(state: Column, _: Column) -> Column:
        terms = F.zip_with(state["ring"], F.col("weights"), lambda v, w: v * w)
        found = F.array(F.aggregate(terms, F.col("base"), lambda acc, term: acc + term))
        ring = F.concat(F.slice(state["ring"], F.lit(2), F.size("seq") - 1), found)
        return F.struct(ring.alias("ring"), F.concat(state["path"], found).alias("path"))

    start = F.struct(F.col("seq").alias("ring"), F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, extend, lambda state: state["path"])
    return (
        sequences.withColumns({"weights": weights, "base": base})
        .withColumn("path", path)
        .select(*SERIES, "last_date", F.posexplode("path").alias("step", "yhat"))
        .select(
            F.lit(model).alias("model"),
            *SERIES,
            F.date_add("last_date", F.col("step") + 1).alias("date"),
            (F.col("step") + 1).alias("step"),
            "yhat",
        )
    )


# A backtest history is one series cut before one horizon.
HISTORY = ("horizon", "days", *SERIES)


def histories(panel: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """For each horizon, the rows up to its length before each series' last date, with ``t``.

    All horizons are cut in one pass: a row is repeated for every horizon whose history
    it belongs to, inside the partitioning by series.
    """
    wanted = F.filter(
        F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("days")) for h, d in horizons.items())),
        lambda h: F.col("date") <= F.date_sub("_last", h["days"]),
    )
    return (
        with_position(panel)
        .withColumn("_last", F.max("date").over(whole_series()))
        .select(*SERIES_DAY, "sales", "t", F.inline(wanted))
    )


def backtest(panel: DataFrame, horizons: Mapping[str, int], forecaster: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Forecast each horizon from the history before it and join the actuals by date.

    ``forecaster(history)`` gets rows keyed by :data:`HISTORY` and returns ``model``,
    those keys, ``date, step, yhat``. A series without history before a horizon has
    no rows for it.
    """
    return join_actuals(forecaster(histories(panel, horizons)), panel).drop("days")


def hold_last(history: DataFrame) -> DataFrame:
    """Forecaster for :func:`backtest`: the last value, repeated."""
    held = history.groupBy(*HISTORY).agg(
        F.max_by(F.col("sales").cast("double"), "date").alias("yhat"), F.max("date").alias("last_date")
    )
    return future_days(held, F.col("days")).select(
        F.lit("persistence").alias("model"), *HISTORY, "date", "step", "yhat"
    )


def extend_trend(history: DataFrame) -> DataFrame:
    """Forecaster for :func:`backtest`: the linear trend, continued."""
    return trend_forecast(fit_line(history, HISTORY), F.col("days"), HISTORY)


def hold_and_extend(history: DataFrame) -> DataFrame:
    """Forecaster for :func:`backtest`: the last value and the linear trend, from one aggregation of the history."""
    fits = history.groupBy(*HISTORY).agg(
        F.max_by(F.col("sales").cast("double"), "date").alias("held"),
        F.regr_slope("sales", "t").alias("slope"),
        F.regr_intercept("sales", "t").alias("intercept"),
        F.count("*").alias("n_rows"),
        F.max("date").alias("last_date"),
    )
    line = F.col("intercept") + F.col("slope") * (F.col("n_rows") - 1 + F.col("step"))
    both = F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("held").alias("yhat")),
        F.struct(F.lit("linear_trend").alias("model"), line.alias("yhat")),
    )
    return future_days(fits, F.col("days")).select(*HISTORY, "date", "step", F.inline(both)).select("model", *HISTORY, "date", "step", "yhat")


# Largest step of the descent in each smoothing weight, how often steps are halved, and the weights' limits.
DESCENT_STEP, DESCENT_HALVINGS, WEIGHT_LIMITS = 0.2, 7, (0.001, 0.999)
# Series whose recursions run side by side in a task.
SERIES_SIDE_BY_SIDE = 32


def optimised_smoothing(
    panel: DataFrame,
    steps: int = LONGEST,
    season: int = SEASON,
    grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID,
    halvings: int = DESCENT_HALVINGS,
) -> DataFrame:
    """:func:`seasonal_smoothing` with weights found by descent from the best grid point, so never with a larger error.

    A step tries each weight more and less by the step size, alone and together, moves to the best try
    while one is better, and then halves the size. Returns ``alpha, beta, gamma`` and ``sse`` beside the columns of the path. The recursion over
    time runs for all tries of a bounded number of series at once.
    """
    schema = "store {}, item {}, date date, step int, kind string, yhat double, alpha double, beta double, gamma double, sse double".format(
        *(panel.schema[c].dataType.simpleString() for c in SERIES)
    )
    points = [tuple(map(float, point)) for point in grid]

    def smooth(rows):
        import numpy as np
        import pandas as pd

        series = [(key, own.sort_values("date")) for key, own in rows.groupby(["store", "item"], sort=True)]
        series = [(key, own["date"].to_numpy(), own["sales"].to_numpy(dtype=float)) for key, own in series if len(own) >= 2 * season]
        columns = ["store", "item", "date", "step", "kind", "yhat", "alpha", "beta", "gamma", "sse"]
        if not series:
            return pd.DataFrame(columns=columns, dtype=object)
        values = [x for _, _, x in series]
        tried = smoothing_errors(values, np.repeat(np.array(points)[None], len(values), axis=0), season)
        best = tried.argmin(axis=1)
        weights, errors = np.array(points)[best], tried[np.arange(len(values)), best]
        moves = np.array([m for m in itertools.product((-1.0, 0.0, 1.0), repeat=3) if any(m)])
        for size in (DESCENT_STEP / 2**k for k in range(halvings)):
            moving = np.arange(len(values))
            while len(moving):
                tries = np.clip(weights[moving, None] + size * moves[None], *WEIGHT_LIMITS)
                tried = smoothing_errors([values[i] for i in moving], tries, season)
                at = tried.argmin(axis=1)
                found = tried[np.arange(len(moving)), at]
                better = found < errors[moving]
                weights[moving[better]], errors[moving[better]] = tries[better, at[better]], found[better]
                moving = moving[better]
        parts = []
        for (key, dates, x), chosen, sse in zip(series, weights, errors):
            fitted, ahead = smoothing_path(x, chosen, season, steps)
            later = pd.Timestamp(dates[-1]) + pd.to_timedelta(np.arange(1, steps + 1), unit="D")
            part = {"store": key[0], "item": key[1], "date": [*dates, *later.date], "step": np.concatenate([np.zeros(len(x), int), np.arange(1, steps + 1)])}
            part |= {"kind": ["fitted"] * len(x) + ["forecast"] * steps, "yhat": np.concatenate([fitted, ahead])}
            parts.append(pd.DataFrame(part | dict(zip(("alpha", "beta", "gamma"), chosen)) | {"sse": sse})[columns])
        return pd.concat(parts, ignore_index=True)

    # Groups of a bounded number of series, whatever their keys.
    sized = panel.groupBy(*SERIES).agg(F.count("*").alias("n")).agg(F.ceil(F.count("*") / SERIES_SIDE_BY_SIDE).alias("groups")).scalar()
    dealt = panel.select(*SERIES_DAY, "sales").withColumn("deal", F.pmod(F.xxhash64(*SERIES), F.greatest(sized, F.lit(1))))
    return (
        dealt.groupBy("deal")
        .applyInPandas(lambda rows: smooth(rows.drop(columns="deal")), schema)
        .withColumn("model", F.lit("optimised_smoothing"))
        .select("model", *SERIES_DAY, "step", "kind", "yhat", "alpha", "beta", "gamma", "sse")
    )


def smoothing_errors(series: Sequence, weights, season: int):
    """Sums of squared one-step errors, series by try. ``weights``: series x tries x 3."""
    import numpy as np

    lengths = np.array([len(x) for x in series])
    order = np.argsort(-lengths, kind="stable")
    lengths, weights = lengths[order], weights[order]
    values = np.zeros((len(series), lengths[0]))
    for row, i in enumerate(order):
        values[row, : len(series[i])] = series[i]
    alpha, beta, gamma = weights[:, :, 0], weights[:, :, 1], weights[:, :, 2]
    first, second = values[:, :season], values[:, season : 2 * season]
    shape = alpha.shape
    level = np.repeat(first.mean(axis=1)[:, None], shape[1], axis=1)
    trend = np.repeat(((second - first).mean(axis=1) / season)[:, None], shape[1], axis=1)
    seasons = np.repeat((first - first.mean(axis=1)[:, None]).T[:, :, None], shape[1], axis=2)
    errors = np.zeros(shape)
    # Longest first, so the series that still run are the first ones.
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for t in range(lengths[0]):
        n, slot = running[t], t % season
        actual = values[:n, t, None]
        base = level[:n] + trend[:n]
        old = seasons[slot, :n]
        errors[:n] += (actual - base - old) ** 2
        new = alpha[:n] * (actual - old) + (1 - alpha[:n]) * base
        trend[:n] = beta[:n] * (new - level[:n]) + (1 - beta[:n]) * trend[:n]
        seasons[slot, :n] = gamma[:n] * (actual - base) + (1 - gamma[:n]) * old
        level[:n] = new
    out = np.empty(shape)
    out[order] = errors
    return out


def smoothing_path(x, weights, season: int, steps: int):
    """Fitted values and forecasts under one set of weights."""
    import numpy as np

    alpha, beta, gamma = map(float, weights)
    level = float(np.mean(x[:season]))
    trend = float(np.mean(x[season : 2 * season]) - level) / season
    seasons = [float(v) - level for v in x[:season]]
    fitted = []
    for t, actual in enumerate(x.tolist()):
        slot, base = t % season, level + trend
        fitted.append(base + seasons[slot])
        new = alpha * (actual - seasons[slot]) + (1 - alpha) * base
        seasons[slot] = gamma * (actual - base) + (1 - gamma) * seasons[slot]
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    ahead = [level + trend * k + seasons[(len(x) + k - 1) % season] for k in range(1, steps + 1)]
    return np.array(fitted), np.array(ahead)
