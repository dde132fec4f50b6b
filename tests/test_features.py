import datetime as dt
import random
import statistics

import pytest

from pyspark.sql import functions as F

from shelfcast.operators.codes import category_codes, with_category_codes, with_global_position
from shelfcast.operators.features import (
    complete_rows,
    direct_windows,
    feature_frame,
    lookback_sequences,
    with_lags,
    with_rolls,
)
from shelfcast.operators.splits import with_ratio_split, with_time_split
from shelfcast.plans.training_run import training_frame
from shelfcast.sources.panel import as_panel, densify


def ordered(df):
    return df.orderBy("store", "item", "date").collect()


def test_rolling_excludes_the_current_row(make_panel):
    rows = ordered(with_rolls(make_panel({(1, 1): [10, 20, 40]}), (7,)))
    assert [r.roll_mean_7 for r in rows] == [None, 10, 15]
    assert [r.roll_std_7 for r in rows][:2] == [None, None]
    assert rows[2].roll_std_7 == pytest.approx(7.071068, abs=1e-6)


def test_rolling_sums_equal_plain_frames(make_panel):
    rng = random.Random(1)
    series = {(s, i): [rng.choice([None, 0, 3, 1000, 250_000]) for _ in range(90)] for s in (1, 2) for i in (1, 2)}
    whole = with_rolls(make_panel(series))
    frames = with_rolls(make_panel(series).withColumn("sales", F.col("sales").cast("double")))
    for a, b in zip(ordered(whole), ordered(frames)):
        for name in (c for c in whole.columns if c.startswith("roll_")):
            assert a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-6) if b[name] is not None else a[name] is None


def test_rolling_sums_of_very_large_values(make_panel):
    values = [2_900_000_000 - (t * 7919) % 1_000_003 for t in range(70)]
    rows = ordered(with_rolls(make_panel({(1, 1): values, (2, 2): [3_000_000_000] * 70})))
    for t in (5, 40, 69):
        window = values[max(0, t - 28) : t]
        assert rows[t].roll_mean_28 == pytest.approx(statistics.mean(window), rel=1e-12)
        assert rows[t].roll_std_28 == pytest.approx(statistics.stdev(window), rel=1e-6)
    assert rows[-1].roll_std_60 == 0 and rows[-1].roll_mean_60 == 3_000_000_000


def test_features_do_not_see_the_present_or_future(make_panel):
    past = list(range(1, 81))
    a = ordered(feature_frame(make_panel({(1, 1): past + [5] * 10})))
    b = ordered(feature_frame(make_panel({(1, 1): past + [900] * 10})))
    columns = [c for c in a[0].asDict() if c.startswith(("lag_", "roll_"))]
    assert [[r[c] for c in columns] for r in a[:81]] == [[r[c] for c in columns] for r in b[:81]]


def test_lags_count_rows_and_densify_makes_them_days(spark):
    rows = [(dt.date(2022, 1, 1), 1, 1, 5), (dt.date(2022, 1, 4), 1, 1, 7)]
    panel = spark.createDataFrame(rows, "date date, store int, item int, sales bigint")
    assert ordered(with_lags(panel, (1,)))[1].lag_1 == 5
    dense = ordered(with_lags(densify(panel), (1, 3)))
    assert [(r.sales, r.lag_1, r.lag_3) for r in dense] == [(5, None, None), (0, 5, None), (0, 0, None), (7, 0, 5)]


def test_repeated_days_and_undated_rows(spark):
    rows = [(dt.date(2022, 1, 1), 1, 1, 5), (dt.date(2022, 1, 1), 1, 1, 2), (None, 1, 1, 9)]
    panel = as_panel(spark.createDataFrame(rows, "date date, store int, item int, sales bigint"))
    assert [tuple(r) for r in panel.collect()] == [(dt.date(2022, 1, 1), 1, 1, 7)]


def test_sequences_stay_inside_their_part(make_panel):
    split = with_time_split(make_panel({(1, 1): list(range(20))}), 8)
    inside = ordered(lookback_sequences(split, 3))
    assert [(r.y, r.split) for r in inside][:1] == [(3, "train")]
    val = [r for r in inside if r.split == "val"]
    assert [r.y for r in val] == [15, 16, 17, 18, 19] and val[0].seq == [12, 13, 14]
    across = [r for r in ordered(lookback_sequences(split, 3, across_split=True)) if r.split == "val"]
    assert [r.y for r in across] == list(range(12, 20)) and across[0].seq == [9, 10, 11]


def test_direct_windows_and_ratio_split(make_panel):
    panel = make_panel({(1, 1): list(range(10)), (2, 1): list(range(4))})
    windows = with_ratio_split(direct_windows(panel, 3, {"near": 2}, ("sales",), min_windows=0))
    rows = windows.orderBy("i").collect()
    assert {r.store for r in rows} == {1}
    assert [r.y for r in rows] == [4, 5, 6, 7, 8, 9]
    assert [v.sales for v in rows[0].x] == [0, 1, 2]
    assert [r.split for r in rows] == ["train"] * 4 + ["val"] + ["test"]
    assert direct_windows(panel, 3, {"near": 2}, ("sales",), min_windows=6).count() == 0


def test_time_split_is_disjoint_and_whole(make_panel):
    panel = make_panel({(1, 1): list(range(100)), (2, 5): list(range(70))})
    split = with_time_split(panel, 30)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 170 and counts["val"] == 30
    assert split.where("split = 'train'").agg(F.max("date")).first()[0] == split.first().cutoff


def test_positions_follow_the_order_over_many_partitions(spark):
    df = spark.range(5000).select(F.expr("id * 7919 % 5003").alias("k")).repartition(7)
    rows = with_global_position(df, ["k"]).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.pos)] == sorted(r.k for r in rows)
    assert sorted(r.pos for r in rows) == list(range(5000))


def test_codes_sort_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (100,), (9,), (None,)], "store int")
    assert {r.store: r.store_code for r in category_codes(df, "store").collect()} == {9: 0, 10: 1, 100: 2}
    assert {r.store: r.store_code for r in with_category_codes(df, ["store"]).collect()} == {9: 0, 10: 1, 100: 2, None: -1}


def test_training_frame_drops_before_it_codes(make_panel):
    panel = make_panel({(3, 8): list(range(70)), (4, 9): list(range(20)), (5, 9): list(range(61))})
    rows = training_frame(panel).collect()
    assert len(rows) == 11
    assert {(r.store, r.store_code, r.item, r.item_code) for r in rows} == {(3, 0, 8, 0), (5, 1, 9, 1)}
    assert complete_rows(feature_frame(panel)).count() == 11


def test_sequences_with_a_null_are_left_out(make_panel):
    sales = list(range(100, 160))
    sales[40] = None
    split = make_panel({(1, 1): sales}).withColumn("split", F.lit("train"))
    rows = sorted(lookback_sequences(split, 28).collect(), key=lambda r: r.date)
    assert [r.y for r in rows] == [v for k, v in enumerate(sales) if k >= 28 and not 40 <= k <= 68]
    assert all(r.seq == sales[k - 28 : k] for r in rows for k in [sales.index(r.y)])


@pytest.mark.parametrize("gap", [False, True])
def test_series_that_keep_a_row(make_panel, gap):
    from shelfcast.plans.training_run import _kept_series

    sales = {(1, 1): [1] * 61, (1, 2): [1] * 60, (2, 1): [None if gap and k % 30 == 0 else 1 for k in range(70)], (2, 2): [2] * 90}
    kept = {tuple(r) for r in _kept_series(make_panel(sales)).collect()}
    by_lags = {(r.store, r.item) for r in complete_rows(with_lags(make_panel(sales))).select("store", "item").distinct().collect()}
    assert kept == by_lags


def test_rolling_sums_of_values_around_a_trillion(make_panel):
    """Values of 10**12 that differ by a few units, after a jump from zero: no overflow, and no digits lost."""
    values = [0] * 5 + [10**12 + v for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9)] + [-(10**12), 10**14, 7]
    rows = with_rolls(make_panel({(1, 1): values}), (3, 7)).orderBy("date").collect()
    for t in range(2, len(values)):
        for width in (3, 7):
            window = values[max(0, t - width) : t]
            assert rows[t][f"roll_mean_{width}"] == pytest.approx(statistics.mean(window), rel=1e-12)
            assert rows[t][f"roll_std_{width}"] == pytest.approx(statistics.stdev(window), rel=1e-12)
