"""Lag, rolling and sequence features. All windows share one partitioning and order,
so a chain of these functions needs a single shuffle and a single sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import SERIES
from shelfcast.functions.calendar import CALENDAR_COLUMNS, with_calendar

# The feature set of the forecasting models.
LAGS = (1, 7, 14, 28, 60)
ROLL_WIDTHS = (7, 14, 28, 60)
LOOKBACK = 28
WINDOW_ROWS = 30
HORIZONS = {"1 month": 30, "3 months": 90, "1 year": 365}

LAG_COLUMNS = tuple(f"lag_{n}" for n in LAGS)
ROLL_COLUMNS = tuple(f"roll_{stat}_{n}" for stat in ("mean", "std") for n in ROLL_WIDTHS)
FEATURES = ("store_code", "item_code", *CALENDAR_COLUMNS, *LAG_COLUMNS, *ROLL_COLUMNS)


def by_date(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def whole_series(keys: Sequence[str] = SERIES) -> WindowSpec:
    """All rows of the series. Ordered like the other windows, so both share one sort."""
    return by_date(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


# The same order as SQL text. Wide feature sets are written as SQL, which Spark parses
# faster than the equivalent chain of Column calls is built.
BY_DATE = f"PARTITION BY {', '.join(SERIES)} ORDER BY date"


def with_lags(df: DataFrame, lags: Sequence[int] = LAGS, value: str = "sales") -> DataFrame:
    """``lag_L``: the value L rows (not days) earlier in the series."""
    return df.withColumns({f"lag_{n}": F.expr(f"lag({value}, {n}) OVER ({BY_DATE})") for n in lags})


# Values are split into multiples of this and remainders, whose products are summed apart.
LIMB = 1 << 24


def with_rolls(df: DataFrame, widths: Sequence[int] = ROLL_WIDTHS, value: str = "sales") -> DataFrame:
    """``roll_mean_W`` and ``roll_std_W`` over the W rows before the current one.

    Whole-number values take differences of running sums: they are exact, and the cost
    per row does not grow with W. Squares are summed in three parts, so that the sums
    cannot overflow while a series has up to 8,000 rows and varies by less than 10**15 units, and joined as exact decimals.
    Fractional values use plain frames, as running sums would lose digits.
    """
    if isinstance(df.schema[value].dataType, T.IntegralType):
        return _rolls_from_running_sums(df, widths, value)
    frame = f"OVER ({BY_DATE} ROWS BETWEEN {{}} PRECEDING AND 1 PRECEDING)".format
    means = {f"roll_mean_{w}": F.expr(f"avg({value}) {frame(w)}") for w in widths}
    spreads = {f"roll_std_{w}": F.expr(f"stddev_samp({value}) {frame(w)}") for w in widths}
    return df.withColumns(means | spreads)


def _rolls_from_running_sums(df: DataFrame, widths: Sequence[int], value: str) -> DataFrame:
    # Values are taken relative to the series' first one, which keeps squares small.
    first = f"first_value({value}) IGNORE NULLS OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = df.withColumn("_first", F.expr(f"CAST({first} AS BIGINT)"))
    x = f"({value} - _first)"
    high, low = f"({x} div {LIMB})", f"({x} % {LIMB})"
    before = f"OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    running = {
        "_n": f"count({x})",
        "_s": f"sum({x})",
        "_hh": f"sum({high} * {high})",
        "_hl": f"sum({high} * {low})",
        "_ll": f"sum({low} * {low})",
    }
    sums = df.withColumns({name: F.expr(f"coalesce({total} {before}, 0)") for name, total in running.items()})
    frames = sums.withColumns(
        {
            f"{name}{w}": F.expr(f"{name} - coalesce(lag({name}, {w}) OVER ({BY_DATE}), 0)")
            for name in running
            for w in widths
        }
    )
    means = {f"roll_mean_{w}": F.expr(f"try_divide(_s{w} + _n{w} * _first, _n{w})") for w in widths}
    # n times the sum of squares less the squared sum, exact before it is divided.
    whole = lambda name: f"CAST({name} AS DECIMAL(19, 0))"
    squares = {
        f"_q{w}": F.expr(f"CAST({whole(f'_hh{w}')} * {LIMB * LIMB} + {whole(f'_hl{w}')} * {2 * LIMB} + {whole(f'_ll{w}')} AS DECIMAL(38, 0))") for w in widths
    }
    variances = {
        f"_v{w}": F.expr(f"try_divide(CAST(_n{w} * _q{w} - {whole(f'_s{w}')} * {whole(f'_s{w}')} AS DOUBLE), CAST(_n{w} * (_n{w} - 1) AS DOUBLE))") for w in widths
    }
    spreads = {f"roll_std_{w}": F.expr(f"sqrt(_v{w})") for w in widths}
    temporary = ["_first", *running, *(f"{name}{w}" for name in (*running, "_q", "_v") for w in widths)]
    return frames.withColumns(squares).withColumns(variances).withColumns(means | spreads).drop(*temporary)


def feature_frame(panel: DataFrame) -> DataFrame:
    """Panel plus calendar, lag and rolling features; incomplete rows are kept."""
    return with_rolls(with_lags(with_calendar(panel)))


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows whose lags all exist, which drops the first 60 rows of each series."""
    return features.dropna(subset=list(LAG_COLUMNS))


def with_position(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``t``: 0-based position in the series."""
    return df.withColumn("t", F.row_number().over(by_date(keys)) - 1)


def lookback_sequences(
    split: DataFrame, lookback: int = LOOKBACK, value: str = "sales", across_split: bool = False
) -> DataFrame:
    """``seq``: the ``lookback`` values before each row, as an array; ``y``: the row's value.

    Sequences are cut inside each part of the split, so the first ``lookback`` rows of
    both parts have none; ``across_split=True`` lets validation rows look back into
    the training part. A part is contiguous in time, so it is enough to know a row's
    position in its part; no second sort by part is needed.

    A sequence stands for rows, so a row whose value is NULL keeps its place; sequences that hold
    a NULL, and rows whose own value is NULL, are left out, as a model can use neither.
    """
    rows = F.collect_list(F.struct(F.col(value).alias("v"))).over(by_date().rowsBetween(-lookback, -1))
    position = F.row_number().over(by_date()) - 1
    train_rows = F.count_if(F.col("split") == "train").over(whole_series())
    in_part = F.when(F.col("split") == "train", F.col("_t")).otherwise(F.col("_t") - F.col("_train_rows"))
    usable = F.col("_t") if across_split else in_part
    return (
        split.withColumns({"_rows": rows, "_t": position, "_train_rows": train_rows})
        .where(usable >= lookback)
        .withColumn("seq", F.transform("_rows", lambda r: r["v"]))
        .where(F.forall("seq", lambda v: v.isNotNull()) & F.col(value).isNotNull())
        .withColumn("y", F.col(value))
        .drop("_rows", "_t", "_train_rows")
    )


def direct_windows(
    frame: DataFrame,
    window: int = WINDOW_ROWS,
    horizons: dict[str, int] = HORIZONS,
    inputs: Sequence[str] = ("sales", "day_of_week", "month", "holiday"),
    min_windows: int = 100,
) -> DataFrame:
    """Windows of ``window`` rows and the value ``h`` rows after their last row, for each horizon.

    A row per (series, anchor date, horizon): ``x`` the array of input structs, ``y``,
    ``i`` the 0-based window number and ``n`` the number of windows. Series shorter
    than window + longest horizon are skipped, as are horizons with no more than
    ``min_windows`` windows.
    """
    length = F.count("*").over(whole_series())
    x = F.collect_list(F.struct(*inputs)).over(by_date().rowsBetween(1 - window, 0))
    targets = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(h).alias("horizon"), F.lead("sales", h).over(by_date()).alias("y"))
            for name, h in horizons.items()
        )
    )
    windows = F.col("length") - window - F.col("horizon") + 1
    return (
        frame.withColumns({"length": length, "x": x, "t": F.row_number().over(by_date()) - 1, "targets": targets})
        .where((F.col("length") >= window + max(horizons.values())) & (F.col("t") >= window - 1))
        .select(*SERIES, F.col("date").alias("anchor_date"), "x", "t", "length", F.inline("targets"))
        .withColumn("n", windows)
        .withColumn("i", F.col("t") - (window - 1))
        .where((F.col("i") < F.col("n")) & (F.col("n") > min_windows))
        .drop("t", "length")
    )
