import datetime as dt

import pytest

from pyspark.sql import functions as F

from shelfcast.operators.scaling import fit_standard, scale_minmax, scale_standard, unscale_minmax, unscale_standard
from shelfcast.operators.splits import (
    choose_pair,
    first_series,
    largest_pairs,
    min_length,
    one_series,
    rows_of,
    trailing_calendar,
    trailing_rows,
)


def keys(df):
    return sorted({(r.store, r.item) for r in df.collect()})


def test_series_selections(make_panel):
    panel = make_panel({(2, 1): [1] * 3, (1, 2): [1] * 5, (1, 1): [1] * 5})
    assert keys(first_series(panel, 2)) == [(1, 1), (1, 2)]
    assert keys(first_series(panel)) == [(1, 1), (1, 2), (2, 1)]
    assert keys(min_length(panel, 4)) == [(1, 1), (1, 2)]
    assert keys(one_series(panel, 2, 1)) == [(2, 1)]
    assert [(r.store, r.item) for r in largest_pairs(panel, 3).collect()] == [(1, 1), (1, 2), (2, 1)]


def test_chosen_pair_falls_back(make_panel):
    coded = lambda s: make_panel(s).withColumns({"store_code": F.col("store"), "item_code": F.col("item")})
    wanted = coded({(0, 0): [1] * 9, (1, 1): [1]})
    zero = coded({(0, 0): [1], (2, 2): [1] * 9})
    longest = coded({(3, 3): [1] * 2, (2, 2): [1] * 4})
    for df, pair in ((wanted, (1, 1)), (zero, (0, 0)), (longest, (2, 2))):
        assert keys(rows_of(df, choose_pair(df))) == [pair]


def test_trailing_windows(make_panel):
    panel = make_panel({(1, 1): list(range(100)), (2, 2): list(range(10))})
    counts = {(r.store, r.window): r["count"] for r in trailing_rows(panel).groupBy("store", "window").count().collect()}
    assert counts == {
        (1, "1 Month"): 30, (1, "3 Months"): 90, (1, "1 Year"): 100,
        (2, "1 Month"): 10, (2, "3 Months"): 10, (2, "1 Year"): 10,
    }
    first = trailing_calendar(panel).where("store = 1").groupBy("window").agg(F.min("date").alias("d"))
    # The series ends on 2022-04-10.
    assert {r.window: r.d for r in first.collect()} == {
        "1 Month": dt.date(2022, 3, 10), "3 Months": dt.date(2022, 1, 10), "1 Year": dt.date(2022, 1, 1),
    }


def test_standard_scale_and_back(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, flat double")
    fitted = fit_standard(df, ["x", "flat"])
    scaled = scale_standard(df, fitted, ["x", "flat"])
    rows = scaled.orderBy("x").collect()
    assert [r.x for r in rows] == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    assert [r.flat for r in rows] == [0, 0, 0]
    back = unscale_standard(scaled, fitted, "x", "x").orderBy("x").collect()
    assert [r.x for r in back] == pytest.approx([1, 2, 4])


def test_minmax_scale_and_back(make_panel):
    panel = make_panel({(1, 1): [2, 4, 10], (2, 2): [7, 7, 7]})
    scaled = scale_minmax(panel, ["sales"], keep_range=True)
    rows = scaled.orderBy("store", "date").collect()
    assert [r.sales for r in rows] == [0, 0.25, 1, 0, 0, 0]
    back = unscale_minmax(scaled, "sales", "sales").orderBy("store", "date").collect()
    assert [r.sales for r in back] == [2, 4, 10, 7, 7, 7]
