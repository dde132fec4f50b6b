"""Splits and row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import SERIES

# Hold-out length in days (short and long study) and shares of the ratio split.
VAL_DAYS = 60
LONG_VAL_DAYS = 365
TRAIN_SHARE = 0.7
TRAIN_AND_VAL_SHARE = 0.85

# Trailing windows in rows and in calendar months.
TRAILING_ROWS = {"1 Month": 30, "3 Months": 90, "1 Year": 365}
TRAILING_MONTHS = {"1 Month": 1, "3 Months": 3, "1 Year": 12}


def cutoff_date(df: DataFrame, val_days: int = VAL_DAYS) -> Column:
    """The last date minus ``val_days``, as a scalar subquery: nothing is collected."""
    return df.agg(F.date_sub(F.max("date"), val_days).alias("cutoff")).scalar()


def with_time_split(df: DataFrame, val_days: int = VAL_DAYS) -> DataFrame:
    """Add ``cutoff`` and ``split``: 'train' up to the cutoff, 'val' after it."""
    return df.withColumn("cutoff", cutoff_date(df, val_days)).withColumn(
        "split", F.when(F.col("date") <= F.col("cutoff"), "train").otherwise("val")
    )


def with_ratio_split(windows: DataFrame) -> DataFrame:
    """Split windows of each series by number: the first 70 % train, up to 85 % val, then test."""
    train_end = F.floor(F.col("n") * F.lit(TRAIN_SHARE))
    val_end = F.floor(F.col("n") * F.lit(TRAIN_AND_VAL_SHARE))
    part = F.when(F.col("i") < train_end, "train").when(F.col("i") < val_end, "val").otherwise("test")
    return windows.withColumn("split", part)


def min_length(df: DataFrame, rows: int) -> DataFrame:
    """Keep the series with at least ``rows`` rows."""
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(*SERIES)))
    return sized.where(F.col("_n") >= rows).drop("_n")


def first_series(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` series in key order; all series when ``n`` is None."""
    if n is None:
        return df
    keys = df.select(*SERIES).distinct().orderBy(*SERIES).limit(n)
    return df.join(keys, list(SERIES), "left_semi")


def one_series(df: DataFrame, store, item) -> DataFrame:
    return df.where((F.col("store") == store) & (F.col("item") == item))


def largest_pairs(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` series with most rows; ties go to the smaller key."""
    counts = df.groupBy(*SERIES).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), *SERIES).limit(n)


def choose_pair(df: DataFrame, wanted: tuple = (1, 1), keys: Sequence[str] = ("store_code", "item_code")) -> DataFrame:
    """One row naming a series: the wanted pair if present, else (0, 0), else the one with most rows."""
    return pick_pair(df.groupBy(*dict.fromkeys((*keys, *SERIES))).agg(F.count("*").alias("n_rows")), wanted, keys)


def pick_pair(counts: DataFrame, wanted: tuple = (1, 1), keys: Sequence[str] = ("store_code", "item_code")) -> DataFrame:
    """:func:`choose_pair` from the number of rows, ``n_rows``, of every series."""
    first, second = keys
    is_wanted = (F.col(first) == wanted[0]) & (F.col(second) == wanted[1])
    is_zero = (F.col(first) == 0) & (F.col(second) == 0)
    return counts.orderBy(is_wanted.desc(), is_zero.desc(), F.desc("n_rows"), first, second).limit(1)


def rows_of(df: DataFrame, pair: DataFrame) -> DataFrame:
    """Rows of the chosen series."""
    return df.join(pair.select(*SERIES), list(SERIES), "left_semi")


def trailing_rows(
    df: DataFrame, windows: dict[str, int] = TRAILING_ROWS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Each row once per window it belongs to: the last n rows of its series."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("date"))
    wanted = F.filter(
        F.array(*(F.struct(F.lit(k).alias("window"), F.lit(n).alias("n")) for k, n in windows.items())),
        lambda w: w["n"] >= F.col("_rn"),
    )
    return (
        df.withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= max(windows.values()))
        .withColumn("window", F.explode(F.transform(wanted, lambda w: w["window"])))
        .drop("_rn")
    )


def trailing_calendar(
    df: DataFrame, windows: dict[str, int] = TRAILING_MONTHS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Each row once per window it belongs to: from k months before the series' last date on."""
    wanted = F.filter(
        F.array(*(F.struct(F.lit(k).alias("window"), F.lit(m).alias("months")) for k, m in windows.items())),
        lambda w: F.col("date") >= F.add_months(F.col("_last"), -w["months"]),
    )
    return (
        df.withColumn("_last", F.max("date").over(Window.partitionBy(*keys)))
        .where(F.col("date") >= F.add_months("_last", -max(windows.values())))
        .withColumn("window", F.explode(F.transform(wanted, lambda w: w["window"])))
        .drop("_last")
    )
