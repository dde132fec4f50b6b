import datetime as dt

import pytest

from shelfcast.operators.features import FEATURES, with_lags, with_rolls
from shelfcast.operators.profile import null_counts
from shelfcast.operators import regressors
from shelfcast.session import build_session, materialize, scratch, shared_dir, shuffle_partitions_for
from shelfcast.sources import results
from shelfcast.sources.panel import as_panel, coerce_dates, save_bucketed_panel, scan_csv, undated_rows, write_panel


def test_csv_scan_turns_bad_dates_into_nulls(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("date,store,item,sales\n2013-01-01,1,1,13\n2013-13-40,1,1,11\n2013-01-02,1,1,\n")
    rows = scan_csv(spark, str(path))
    assert null_counts(rows).first().asDict() == {"sales_nulls": 1, "date_nulls": 1, "store_nulls": 0, "item_nulls": 0}
    kept = as_panel(rows).orderBy("date").collect()
    assert [(r.date, r.sales) for r in kept] == [(dt.date(2013, 1, 1), 13), (dt.date(2013, 1, 2), None)]


def test_panel_files(make_panel, spark, tmp_path):
    panel = make_panel({(1, 1): [1, 2], (2, 2): [3]})
    write_panel(panel, str(tmp_path / "p"))
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(panel.collect())


def test_bucketed_panel_needs_no_shuffle(make_panel, spark, tmp_path):
    panel = make_panel({(s, i): list(range(80)) for s in range(4) for i in range(3)})
    table = save_bucketed_panel(panel, "bucketed_panel", 4, str(tmp_path / "b"))
    features = with_rolls(with_lags(table))
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert features.count() == 960


def test_fingerprint(spark):
    import hashlib

    assert results.feature_fingerprint(spark, ["a", "b"]) == hashlib.md5(b"a|b").hexdigest()[:10]
    assert results.output_root(spark, "out/", FEATURES).startswith("out/feat_")


def test_results_are_found_only_when_all_are_there(spark, tmp_path):
    metrics = spark.createDataFrame([("m", 1.0, 2.0, 0.5, 4.0, 5.0)], "model string, rmse double, mae double, r2 double, mape double, smape double")
    root = str(tmp_path)
    for name in results.RESULT_TABLES:
        assert results.read_all_metrics(spark, root) is None
        results.write_metrics(metrics, root, name)
    assert all(t.collect() == metrics.collect() for t in results.read_all_metrics(spark, root).values())
    assert results.load_model(spark, root, "missing") is None and results.load_scaler(spark, root, "missing") is None
    results.save_scaler(metrics, root, "s")
    assert results.load_scaler(spark, root, "s").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3), "t").count() == 3
    assert build_session() is not None
    assert (shuffle_partitions_for(1), shuffle_partitions_for(10**11), shuffle_partitions_for(10**14)) == (200, 746, 20_000)


def test_without_a_setting_the_warehouse_is_shared():
    class Session:
        class sparkContext:
            made = []

            @classmethod
            def getCheckpointDir(cls):
                return cls.made[-1] if cls.made else None

            @classmethod
            def setCheckpointDir(cls, path):
                cls.made.append(path)

        class conf:
            @staticmethod
            def get(key, default="hdfs:///warehouse/"):
                return default

    assert shared_dir(Session()) == "hdfs:///warehouse/shelfcast-scratch" == Session.sparkContext.made[0]


def test_scratch_is_empty_afterwards(spark):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert materialize(spark.range(3), "gone").count() == 3
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_fingerprints_tell_data_and_models_apart(spark, make_panel):
    one = make_panel({(1, 1): [1, 2, 3]})
    assert results.data_fingerprint(one) == results.data_fingerprint(one.repartition(3))
    others = [make_panel({(1, 1): [1, 2, 4]}), make_panel({(1, 2): [1, 2, 3]}), make_panel({(1, 1): [1, 2, 3, 0]}), make_panel({(1, 1): [3, 2, 1]})]
    assert len({results.data_fingerprint(p) for p in (one, *others)}) == 5
    assert results.estimator_fingerprint(regressors.decision_tree(3)) != results.estimator_fingerprint(regressors.decision_tree(4))
    assert results.feature_digest(FEATURES) == results.feature_fingerprint(spark, FEATURES)


def test_undated_rows_are_counted(spark):
    rows = spark.createDataFrame([("2013-01-01", 1), ("2013-13-40", 1), (None, 2)], "date string, sales int")
    assert tuple(undated_rows(coerce_dates(rows)).first()) == (1, 2)
