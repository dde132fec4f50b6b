"""Forecast error metrics as aggregate expressions over a ``y`` and a ``yhat`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "r2", "mape", "smape")

# Fixed value: the denominator offset of the smoothed percentage errors.
SMOOTHING = 1e-10


def _sides(y: str, yhat: str) -> tuple[str, str, str]:
    """Both sides as doubles, and their difference, as SQL text."""
    actual, guess = f"CAST({y} AS DOUBLE)", f"CAST({yhat} AS DOUBLE)"
    return actual, guess, f"({actual} - {guess})"


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    _, _, e = _sides(y, yhat)
    return F.expr(f"sqrt(avg({e} * {e}))")


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    _, _, e = _sides(y, yhat)
    return F.expr(f"avg(abs({e}))")


def r2(y: str = "y", yhat: str = "yhat") -> Column:
    """NULL below two rows. For a constant ``y``: 1 when every error is 0, else 0."""
    actual, _, e = _sides(y, yhat)
    residual = f"sum({e} * {e})"
    total = f"(var_pop({actual}) FILTER (WHERE {e} IS NOT NULL) * count({e}))"
    return F.expr(
        f"""CASE WHEN count({e}) < 2 THEN NULL
                 WHEN {total} = 0 THEN if({residual} = 0, 1.0D, 0.0D)
                 ELSE 1 - try_divide({residual}, {total}) END"""
    )


def mape(y: str = "y", yhat: str = "yhat", smoothing: float | None = None) -> Column:
    """Percent. Rows with ``y = 0`` are left out, 0 if none remain; with ``smoothing``
    no row is left out and the denominator is ``|y| + smoothing``."""
    actual, _, e = _sides(y, yhat)
    if smoothing is not None:
        return F.expr(f"avg(abs({e}) / (abs({actual}) + {smoothing}D)) * 100")
    return F.expr(f"coalesce(avg(abs(try_divide({e}, {actual}))), 0.0D) * 100")


def smape(y: str = "y", yhat: str = "yhat", smoothing: float | None = None) -> Column:
    """Percent, 0 to 200. Rows where both sides are 0 are left out, 0 if none remain."""
    actual, guess, e = _sides(y, yhat)
    half = f"((abs({actual}) + abs({guess})) / 2)"
    if smoothing is not None:
        return F.expr(f"avg(abs({e}) / ({half} + {smoothing}D)) * 100")
    return F.expr(f"coalesce(avg(try_divide(abs({e}), {half})), 0.0D) * 100")


def all_metrics(y: str = "y", yhat: str = "yhat") -> list[Column]:
    return [
        rmse(y, yhat).alias("rmse"),
        mae(y, yhat).alias("mae"),
        r2(y, yhat).alias("r2"),
        mape(y, yhat).alias("mape"),
        smape(y, yhat).alias("smape"),
    ]
