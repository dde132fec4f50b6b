import random

import numpy as np
import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.operators import autocorr
from shelfcast.operators.profile import PERCENTILE_POINTS, dataset_overview, extremes, key_counts, null_counts
from shelfcast.operators.quantiles import box_plot, histogram, percentiles, value_counts


def counts_of(spark, values):
    return value_counts(spark.createDataFrame([(float(v),) for v in values], "x double"), "x")


def values_by_p(counts, points):
    return {r.p: r.value for r in percentiles(counts, points).collect()}


def test_percentile_fixture(spark):
    assert values_by_p(counts_of(spark, [1, 2, 4, 9, 9]), (25, 50, 90)) == {25: 2, 50: 4, 90: 9}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 2000), min_size=1, max_size=300))
def test_percentiles_equal_numpy(spark, values):
    found = values_by_p(counts_of(spark, values), PERCENTILE_POINTS)
    assert [found[p] for p in PERCENTILE_POINTS] == pytest.approx(np.percentile(values, PERCENTILE_POINTS))


def test_percentiles_with_one_hot_value(spark):
    rng = random.Random(3)
    values = [7.0] * 4000 + [rng.lognormvariate(3, 2) for _ in range(6000)]
    found = values_by_p(counts_of(spark, values), PERCENTILE_POINTS)
    assert [found[p] for p in PERCENTILE_POINTS] == pytest.approx(np.percentile(values, PERCENTILE_POINTS))


@pytest.mark.parametrize("values", [[5, 5, 5], list(range(1, 452)), [0.1 * i for i in range(97)], [3, 8]])
def test_histogram_equals_numpy(spark, values):
    rows = histogram(counts_of(spark, values), 50).orderBy("bin").collect()
    expected, edges = np.histogram(values, 50)
    assert [r.n for r in rows] == expected.tolist()
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())


def test_box_plot(spark):
    row = box_plot(counts_of(spark, [1, 2, 3, 4, 5, 6, 7, 50])).first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.n_outliers) == (2.75, 4.5, 6.25, 1, 7, 1)


def test_overview_nulls_and_counts(make_panel):
    panel = make_panel({(1, 1): [1, 2, None], (1, 2): [5], (2, 1): [7, 8]})
    o = dataset_overview(panel).first()
    assert (o.n_rows, o.n_stores, o.n_items, o.n_pairs, o.duration_days, o.rows_per_store) == (6, 2, 2, 3, 2, 3)
    assert null_counts(panel).first().asDict() == {"sales_nulls": 1, "date_nulls": 0, "store_nulls": 0, "item_nulls": 0}
    levels = {(r.level, r.store, r.item): r.n_rows for r in key_counts(panel).collect()}
    assert levels[("store", 1, None)] == 4 and levels[("item", None, 1)] == 5 and levels[("pair", 2, 1)] == 2
    assert len(levels) == 7


def test_ties_go_to_the_smallest_key(make_panel):
    found = {r.what: r.label for r in extremes(make_panel({(2, 9): [3, 3], (1, 8): [3, 3]})).collect()}
    assert (found["top_store"], found["top_item"], found["most_volatile_item"]) == ("1", "8", "8")
    # 2022-01-01 is a Saturday.
    assert (found["busiest_day"], found["quietest_day"], found["peak_month"]) == ("Sat", "Sat", "Jan")


def brute_acf(x, lags):
    d = np.asarray(x, float) - np.mean(x)
    return [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(lags + 1)]


def brute_pacf(r, lags):
    out = [1.0]
    for k in range(1, lags + 1):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(toeplitz, r[1 : k + 1])[-1]))
    return out


def test_acf_and_pacf_fixture(make_panel):
    arrays = autocorr.correlation_arrays(make_panel({(1, 1): [1, 2, 3, 4]}), 3)
    rows = autocorr.acf(arrays, 3).orderBy("lag").collect()
    assert [r.acf for r in rows] == pytest.approx([1, 0.25, -0.3, -0.45])
    assert [r.band for r in rows][:3] == pytest.approx([0, 1.96 / 2, 1.96 * np.sqrt((1 + 2 * 0.0625) / 4)])
    partial = autocorr.pacf(arrays, 2).orderBy("lag").collect()
    assert [r.pacf for r in partial] == pytest.approx([1, 0.25, -0.386667], abs=1e-6)


def test_acf_of_several_series_against_brute_force(make_panel):
    rng = random.Random(5)
    series = {(s, 1): [rng.randint(0, 50) for _ in range(60 + 10 * s)] for s in range(3)} | {(9, 9): [4] * 40}
    arrays = autocorr.correlation_arrays(make_panel(series), 12)
    acf = {(r.store, r.lag): r.acf for r in autocorr.acf(arrays, 12).collect()}
    pacf = {(r.store, r.lag): r.pacf for r in autocorr.pacf(arrays, 12).collect()}
    for (store, _), x in list(series.items())[:3]:
        expected = brute_acf(x, 12)
        assert [acf[store, k] for k in range(13)] == pytest.approx(expected)
        assert [pacf[store, k] for k in range(13)] == pytest.approx(brute_pacf(expected, 12))
    assert acf[9, 3] is None


def test_panel_acf_does_not_depend_on_blocks(make_panel, monkeypatch):
    rng = random.Random(6)
    panel = make_panel({(s, i): [rng.randint(0, 9) for _ in range(40)] for s in (1, 2) for i in (1, 2)})
    x = [r.sales for r in panel.orderBy("date", "store", "item").collect()]
    for block in (8, 100_000):
        monkeypatch.setattr(autocorr, "BLOCK_ROWS", block)
        rows = autocorr.acf(autocorr.panel_correlation_array(panel, 8), 8).orderBy("lag").collect()
        assert [r.acf for r in rows] == pytest.approx(brute_acf(x, 8))


def test_profile_study_returns_the_single_tables(make_panel):
    from shelfcast.operators import profile, quantiles
    from shelfcast.plans import profile_study

    panel = make_panel({(1, 1): [5, 1, 4, 4], (1, 2): [9, 2, 7], (2, 1): [3] * 6})
    study = profile_study.run(panel)
    single = {
        "overview": profile.dataset_overview(panel),
        "moments": profile.moments(panel),
        "percentiles": profile.sales_percentiles(panel),
        "histogram": profile.sales_histogram(panel),
        "log_histogram": profile.sales_histogram(panel, log=True),
        "box_plot": quantiles.box_plot(profile.stored_counts(panel, "sales")),
        "extremes": profile.extremes(panel),
        "rows_per_pair": profile.key_count_histogram(panel, ["store", "item"], profile.PAIR_BINS),
    }
    assert len(study) == 19
    for name, table in single.items():
        plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert plain(study[name]) == plain(table), name


def test_percentiles_take_more_ranges_for_more_values(make_panel, monkeypatch):
    from shelfcast.operators import quantiles

    monkeypatch.setattr(quantiles, "VALUES_PER_RANGE", 2)
    panel = make_panel({(1, 1): list(range(400))})
    assert [r.value for r in quantiles.percentiles(quantiles.value_counts(panel, "sales"), (0, 50, 100)).orderBy("p").collect()] == [0, 199.5, 399]
