import datetime as dt

import pytest

from pyspark.sql import functions as F

from shelfcast.functions.calendar import US_HOLIDAYS, iso_date, one_hot_calendar, with_calendar, with_holiday_flag
from shelfcast.functions.error_metrics import SMOOTHING, all_metrics, mape, smape
from shelfcast.functions.moments import kurtosis_corrected, skewness_corrected


def days(spark, *iso):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in iso], "date date")


def test_calendar_edges(spark):
    rows = {r.date.isoformat(): r for r in with_calendar(days(spark, "2021-01-01", "2024-02-29", "2023-12-31", "2024-01-01")).collect()}
    assert (rows["2021-01-01"].week, rows["2021-01-01"].dow, rows["2021-01-01"].is_year_start) == (53, 4, 1)
    assert (rows["2024-02-29"].is_month_end, rows["2024-02-29"].dayofyear, rows["2024-02-29"].quarter) == (1, 60, 1)
    assert (rows["2023-12-31"].is_year_end, rows["2023-12-31"].is_weekend, rows["2023-12-31"].dow) == (1, 1, 6)
    assert (rows["2024-01-01"].is_month_start, rows["2024-01-01"].week, rows["2024-01-01"].dow) == (1, 1, 0)


def test_holidays_by_list_and_by_table(spark):
    df = days(spark, "2022-07-04", "2022-07-05", "2023-11-23")
    table = days(spark, *US_HOLIDAYS, "2022-07-04")
    for holidays in (US_HOLIDAYS, table):
        flags = {r.date.isoformat(): r.holiday for r in with_holiday_flag(df, holidays).collect()}
        assert flags == {"2022-07-04": 1, "2022-07-05": 0, "2023-11-23": 1}


def test_one_hot_has_one_mark_per_group(spark):
    row = one_hot_calendar(days(spark, "2022-03-07")).first().asDict()
    assert [k for k, v in row.items() if k.startswith(("day_", "month_")) and v == 1] == ["day_0", "month_3"]
    assert days(spark, "2022-03-07").select(iso_date(F.col("date")).alias("d")).first().d == "2022-03-07"


def scored(spark, pairs, *columns):
    return spark.createDataFrame(pairs, "y double, yhat double").agg(*(columns or all_metrics())).first()


def test_metrics_with_a_zero_actual(spark):
    m = scored(spark, [(0.0, 1.0), (2.0, 3.0), (4.0, 2.0)])
    assert tuple(m) == pytest.approx((1.414214, 1.333333, 0.25, 50, 102.222222), abs=1e-6)


def test_metrics_all_zero_and_constant_actual(spark):
    assert tuple(scored(spark, [(0.0, 0.0), (0.0, 0.0)])) == (0, 0, 1, 0, 0)
    assert scored(spark, [(3.0, 4.0), (3.0, 3.0)]).r2 == 0
    assert scored(spark, [(3.0, 4.0)]).r2 is None


def test_smoothed_errors_keep_zero_rows(spark):
    row = scored(spark, [(2.0, 1.0), (0.0, 0.0)], mape(smoothing=SMOOTHING).alias("m"), smape(smoothing=SMOOTHING).alias("s"))
    assert (row.m, row.s) == pytest.approx((25.0, 100 / 3), rel=1e-6)


def test_metrics_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 17).cast("double").alias("y"), (F.col("id") % 13).cast("double").alias("yhat"))
    one = tuple(df.coalesce(1).agg(*all_metrics()).first())
    many = tuple(df.repartition(16).agg(*all_metrics()).first())
    assert one == pytest.approx(many, rel=1e-12)


def test_corrected_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 9)], "x double")
    row = df.agg(skewness_corrected("x").alias("s"), kurtosis_corrected("x").alias("k")).first()
    assert (row.s, row.k) == pytest.approx((0.271668, -2.946492), abs=1e-6)
    flat = df.limit(2).agg(skewness_corrected("x").alias("s"), kurtosis_corrected("x").alias("k")).first()
    assert (flat.s, flat.k) == (None, None)
    same = spark.createDataFrame([(5.0,)] * 6, "x double").agg(skewness_corrected("x").alias("s"), kurtosis_corrected("x").alias("k")).first()
    assert (same.s, same.k) == (0, 0)
