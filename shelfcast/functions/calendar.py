"""Calendar parts of a date column, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels by weekday (Monday first) and by month.
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# The US holidays of 2022 and 2023 that the flag knows by default.
US_HOLIDAYS = (
    "2022-01-01", "2022-01-17", "2022-02-21", "2022-05-30", "2022-07-04",
    "2022-09-05", "2022-10-10", "2022-11-11", "2022-11-24", "2022-12-25",
    "2023-01-01", "2023-01-16", "2023-02-20", "2023-05-29", "2023-07-04",
    "2023-09-04", "2023-10-09", "2023-11-10", "2023-11-23", "2023-12-25",
)

CALENDAR_COLUMNS = (
    "year", "month", "day", "dow", "week", "quarter", "dayofyear",
    "is_weekend", "is_month_start", "is_month_end", "is_year_start", "is_year_end",
)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def calendar_parts(date: str = "date") -> dict[str, Column]:
    """Name -> expression for every calendar feature. Weekdays count from Monday = 0."""
    d = F.col(date)
    jan_first = (F.month(d) == 1) & (F.dayofmonth(d) == 1)
    dec_last = (F.month(d) == 12) & (F.dayofmonth(d) == 31)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "dow": F.weekday(d),
        "week": F.weekofyear(d),
        "quarter": F.quarter(d),
        "dayofyear": F.dayofyear(d),
        "is_weekend": _flag(F.weekday(d).isin(5, 6)),
        "is_month_start": _flag(F.dayofmonth(d) == 1),
        "is_month_end": _flag(d == F.last_day(d)),
        "is_year_start": _flag(jan_first),
        "is_year_end": _flag(dec_last),
    }


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_parts(date))


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), dow + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), month)


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def with_holiday_flag(df: DataFrame, holidays: Sequence[str] | DataFrame = US_HOLIDAYS) -> DataFrame:
    """Add ``holiday`` (0/1). A list of ISO dates becomes a set lookup inside the scan
    stage; a DataFrame with a ``date`` column is joined, and Spark broadcasts it only
    if it is small."""
    if isinstance(holidays, DataFrame):
        marks = holidays.select("date").distinct().withColumn("holiday", F.lit(1))
        return df.join(marks, "date", "left").withColumn("holiday", F.coalesce("holiday", F.lit(0)))
    return df.withColumn("holiday", _flag(iso_date(F.col("date")).isin(list(holidays))))


def one_hot(df: DataFrame, column: str, values: Sequence[int], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": _flag(F.col(column) == v) for v in values})


def one_hot_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """``day_0..day_6`` and ``month_1..month_12`` indicator columns."""
    parts = df.withColumns({"dow": F.weekday(date), "month": F.month(date)})
    return one_hot(one_hot(parts, "dow", range(7), "day"), "month", range(1, 13), "month")
