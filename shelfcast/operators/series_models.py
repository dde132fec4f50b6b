"""One small direct model per series and horizon."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from shelfcast import SERIES
from shelfcast.operators.features import HORIZONS, WINDOW_ROWS
from shelfcast.operators.splits import TRAIN_AND_VAL_SHARE, TRAIN_SHARE

RIDGE_PENALTY = 1.0
# Penalties among which the validation windows choose.
RIDGE_PENALTIES = (0.0, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
# Directions of the inputs below this share of the strongest one carry rounding only.
LEAST_DIRECTION = 1e-10


def per_series_ridge(
    frame: DataFrame,
    window: int = WINDOW_ROWS,
    horizons: Mapping[str, int] = HORIZONS,
    inputs: Sequence[str] = ("sales", "day_of_week", "month", "holiday"),
    min_windows: int = 100,
    penalty: float = RIDGE_PENALTY,
) -> DataFrame:
    """Ridge regression from the last ``window`` rows to the value ``h`` rows later, per series.

    Fitted on the training windows, scored on the test windows: ``model, store, item,
    anchor_date, horizon, y, yhat``. Inputs are min-max scaled with the range of the
    rows that training windows use. A group is one series, shuffled once as plain
    rows; its windows are views built inside the task, so they are never shuffled.
    """
    schema = "model string, store {}, item {}, anchor_date date, horizon string, y double, yhat double".format(
        *(frame.schema[c].dataType.simpleString() for c in SERIES)
    )
    spans, names = dict(horizons), list(inputs)
    train_share, val_share = TRAIN_SHARE, TRAIN_AND_VAL_SHARE

    def fit_and_score(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("date")
        data = rows[names].to_numpy(dtype=float)
        sales = rows["sales"].to_numpy(dtype=float)
        dates = rows["date"].to_numpy()
        columns = ["model", "store", "item", "anchor_date", "horizon", "y", "yhat"]
        parts = []
        long_enough = len(data) >= window + max(spans.values())
        for name, h in spans.items() if long_enough else ():
            n = len(data) - window - h + 1
            if n <= min_windows:
                continue
            n_train, first_test = int(n * train_share), int(n * val_share)
            seen = data[: n_train + window - 1]
            low = seen.min(axis=0)
            width = seen.max(axis=0) - low
            unit = (data - low) / np.where(width == 0, 1.0, width)
            views = np.lib.stride_tricks.sliding_window_view(unit, window, axis=0)[:n].reshape(n, -1)
            target = sales[window + h - 1 :]
            x, y = views[:n_train], target[:n_train]
            centre, level = x.mean(axis=0), y.mean()
            x = x - centre
            weights = np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ (y - level))
            parts.append(
                pd.DataFrame(
                    {
                        "model": "per_series_ridge",
                        "store": rows["store"].iloc[0],
                        "item": rows["item"].iloc[0],
                        "anchor_date": dates[window - 1 + first_test : window - 1 + n],
                        "horizon": name,
                        "y": target[first_test:n],
                        "yhat": (views[first_test:] - centre) @ weights + level,
                    }
                )
            )
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns, dtype=object)

    keep = list(dict.fromkeys((*SERIES, "date", "sales", *inputs)))
    return frame.select(*keep).groupBy(*SERIES).applyInPandas(fit_and_score, schema)


def chosen_penalty_ridge(
    frame: DataFrame,
    window: int = WINDOW_ROWS,
    horizons: Mapping[str, int] = HORIZONS,
    inputs: Sequence[str] = ("sales", "day_of_week", "month", "holiday"),
    min_windows: int = 100,
    penalties: Sequence[float] = RIDGE_PENALTIES,
) -> DataFrame:
    """:func:`per_series_ridge` whose penalty is the one with the smallest squared error on the validation windows.

    One decomposition of the training windows per series and horizon gives the weights under all penalties; of equal
    errors the first penalty. Fitted on the training windows, scored on the test windows, with ``penalty`` in the result.
    """
    schema = "model string, store {}, item {}, anchor_date date, horizon string, y double, yhat double, penalty double".format(
        *(frame.schema[c].dataType.simpleString() for c in SERIES)
    )
    spans, names, tried = dict(horizons), list(inputs), [float(p) for p in penalties]
    train_share, val_share, least = TRAIN_SHARE, TRAIN_AND_VAL_SHARE, LEAST_DIRECTION

    def fit_and_score(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("date")
        data = rows[names].to_numpy(dtype=float)
        sales, dates = rows["sales"].to_numpy(dtype=float), rows["date"].to_numpy()
        parts = [pd.DataFrame(columns=["model", "store", "item", "anchor_date", "horizon", "y", "yhat", "penalty"], dtype=object)]
        for name, h in spans.items() if len(data) >= window + max(spans.values()) else ():
            n = len(data) - window - h + 1
            if n <= min_windows:
                continue
            n_train, first_test = int(n * train_share), int(n * val_share)
            seen = data[: n_train + window - 1]
            low = seen.min(axis=0)
            width = seen.max(axis=0) - low
            unit = (data - low) / np.where(width == 0, 1.0, width)
            views = np.lib.stride_tricks.sliding_window_view(unit, window, axis=0)[:n].reshape(n, -1)
            target = sales[window + h - 1 :]
            centre, level = views[:n_train].mean(axis=0), target[:n_train].mean()
            x = views[:n_train] - centre
            strength, directions = np.linalg.eigh(x.T @ x)
            strength = np.where(strength > least * max(strength[-1], 0.0), strength, 0.0)
            along = directions.T @ (x.T @ (target[:n_train] - level))
            inverse = [np.divide(1.0, strength + p, out=np.zeros_like(strength), where=strength > 0) for p in tried]
            weights = directions @ (along[:, None] * np.array(inverse).T)
            guesses = (views[n_train:first_test] - centre) @ weights + level
            errors = ((guesses - target[n_train:first_test, None]) ** 2).sum(axis=0)
            best = int(errors.argmin())
            part = {"model": "chosen_penalty_ridge", "store": rows["store"].iloc[0], "item": rows["item"].iloc[0], "anchor_date": dates[window - 1 + first_test : window - 1 + n]}
            part |= {"horizon": name, "y": target[first_test:n], "yhat": (views[first_test:] - centre) @ weights[:, best] + level, "penalty": tried[best]}
            parts.append(pd.DataFrame(part))
        return pd.concat(parts[1:], ignore_index=True) if len(parts) > 1 else parts[0]

    keep = list(dict.fromkeys((*SERIES, "date", "sales", *inputs)))
    return frame.select(*keep).groupBy(*SERIES).applyInPandas(fit_and_score, schema)
