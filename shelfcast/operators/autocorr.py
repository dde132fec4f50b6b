"""Autocorrelation and partial autocorrelation of every series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import SERIES
from shelfcast.operators.codes import with_global_position
from shelfcast.operators.features import whole_series

# Number of lags and the normal quantile of the 95 % bands.
MAX_LAG = 30
Z95 = 1.96

BLOCK_ROWS = 100_000


def _deviation_sums(centred: DataFrame, keys: Sequence[str], order: str, max_lag: int, counted: str = "true") -> DataFrame:
    """Per key: row count ``n`` and the lagged product sums ``c0 .. c<max_lag>`` of column ``d``."""
    window = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"
    lags = range(1, max_lag + 1)
    products = centred.withColumns({f"_d{k}": F.expr(f"lead(d, {k}) {window}") for k in lags}).where(counted)
    return products.groupBy(*keys).agg(
        F.count("d").alias("n"),
        F.expr("sum(d * d)").alias("c0"),
        *(F.expr(f"coalesce(sum(d * _d{k}), 0.0D)").alias(f"c{k}") for k in lags),
    )


def _as_correlations(sums: DataFrame, max_lag: int, keep: Sequence[str]) -> DataFrame:
    ratios = ", ".join(f"try_divide(c{k}, c0)" for k in range(max_lag + 1))
    return sums.select(*keep, "n", F.expr(f"array({ratios})").alias("r"))


def correlation_arrays(df: DataFrame, max_lag: int = MAX_LAG, value: str = "sales") -> DataFrame:
    """``(store, item, n, r)`` with ``r[k]`` the biased autocorrelation at lag k.

    One shuffle and one sort by series: the mean is a window over the whole series and
    the lagged products are summed as they are produced. NULL for a constant series.
    """
    mean = F.avg(value).over(whole_series())
    centred = df.select(*SERIES, "date", (F.col(value) - mean).alias("d"))
    return _as_correlations(_deviation_sums(centred, SERIES, "date", max_lag), max_lag, SERIES)


def panel_correlation_array(df: DataFrame, max_lag: int = MAX_LAG, value: str = "sales") -> DataFrame:
    """``(n, r)`` of the whole panel read as one sequence in (date, store, item) order.

    The sequence is cut into blocks of positions. Each block also gets copies of the
    ``max_lag`` rows that follow it, which only serve as lagged partners, so blocks
    are independent and no task sees the whole sequence.
    """
    placed = with_global_position(df.select("date", *SERIES, value), ["date", *SERIES])
    mean = placed.agg(F.avg(value)).scalar()
    block = F.floor(F.col("pos") / BLOCK_ROWS)
    reaches_back = (F.col("pos") % BLOCK_ROWS < max_lag) & (F.col("pos") >= BLOCK_ROWS)
    homes = F.when(reaches_back, F.array(block, block - 1)).otherwise(F.array(block))
    centred = placed.withColumn("mean", mean).select(
        "pos", (F.col(value) - F.col("mean")).alias("d"), block.alias("home"), F.explode(homes).alias("block")
    )
    sums = _deviation_sums(centred, ["block"], "pos", max_lag, "home = block")
    totals = sums.agg(F.sum("n").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(max_lag + 1)))
    return _as_correlations(totals, max_lag, [])


def acf(arrays: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """One row per lag: ``lag, acf, band``. The band is Bartlett's 95 % half-width."""
    keys = [c for c in arrays.columns if c not in ("n", "r")]
    lag = F.col("lag")
    earlier = F.aggregate(
        F.slice("r", 2, F.greatest(lag - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + r * r
    )
    band = F.when(lag == 0, 0.0).otherwise(F.lit(Z95) * F.sqrt((1 + 2 * earlier) / F.col("n")))
    return arrays.select(*keys, "n", "r", F.posexplode("r").alias("lag", "acf")).select(
        *keys, "lag", "acf", F.when(F.col("acf").isNotNull(), band).alias("band")
    )


def partial_correlations(r: Column, max_lag: int = MAX_LAG) -> Column:
    """Array of partial autocorrelations 0..max_lag by the Levinson-Durbin recursion on ``r``.

    The state holds the current Yule-Walker coefficients and the values found so far.
    """
    def dot(weights: Column, values: Column) -> Column:
        return F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)

    start = F.struct(
        F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("found")
    )

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        recent = F.slice(r, 2, k - 1)
        top = F.element_at(r, k + 1) - dot(phi, F.reverse(recent))
        last = F.try_divide(top, 1 - dot(phi, recent))

        def grown(value: Column) -> Column:
            updated = F.zip_with(phi, F.reverse(phi), lambda a, b: a - value * b)
            return F.struct(
                F.concat(updated, F.array(value)).alias("phi"),
                F.concat(state["found"], F.array(value)).alias("found"),
            )

        # A one-element transform evaluates the new coefficient once per step.
        return F.element_at(F.transform(F.array(last), grown), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step, lambda state: state["found"])


def pacf(arrays: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """One row per lag: ``lag, pacf, band`` with the constant 95 % half-width."""
    keys = [c for c in arrays.columns if c not in ("n", "r")]
    found = partial_correlations(F.col("r"), max_lag)
    band = F.when(F.col("lag") == 0, 0.0).otherwise(F.lit(Z95) / F.sqrt("n"))
    return arrays.select(*keys, "n", F.posexplode(found).alias("lag", "pacf")).select(
        *keys, "lag", "pacf", F.when(F.col("pacf").isNotNull(), band).alias("band")
    )
