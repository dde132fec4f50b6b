"""Plans: shuffles, pushed filters and columns, joins of large and skewed tables."""

import re

import pytest

from pyspark.sql import functions as F

from shelfcast.operators import autocorr, quantiles
from shelfcast.operators.features import complete_rows, feature_frame, lookback_sequences
from shelfcast.operators.splits import with_time_split
from shelfcast.plans import horizon_study, training_run
from shelfcast.sources.panel import panel_from_tables, read_panel_tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def panel(spark):
    return read_panel_tables(spark, FOLDER)


def test_panel_reads_only_its_columns(panel):
    plan = plan_of(panel)
    assert "struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "IsNotNull(l_partkey)" in plan and shuffles(panel) == 1


def test_all_features_share_one_shuffle_and_one_sort(panel):
    features = complete_rows(feature_frame(panel))
    assert shuffles(features) == shuffles(panel) + 1
    assert len(re.findall(r"\bSort \[", plan_of(features))) == 1


def test_sequences_add_no_shuffle(panel):
    split = with_time_split(complete_rows(feature_frame(panel)))
    main = lambda df: plan_of(df).split("Subquery")[0]
    assert main(lookback_sequences(split)).count("Exchange hash") <= 2


def test_acf_shuffles_and_sorts_each_row_once(panel):
    arrays = autocorr.correlation_arrays(panel)
    assert shuffles(arrays) == shuffles(panel) + 1
    assert len(re.findall(r"\bSort \[", plan_of(arrays))) == 1


def test_direct_windows_sort_once(panel):
    assert len(re.findall(r"\bSort \[", plan_of(horizon_study.windows(panel)))) == 1


def test_series_filter_reaches_the_scan(spark):
    df = read_panel_tables(spark, FOLDER).where((F.col("store") == 1) & (F.col("item") == "PROMO"))
    plan = plan_of(df)
    assert "EqualTo(s_nationkey,1)" in plan and "EqualTo(p_type,PROMO)" in plan


def test_no_table_is_broadcast_unchecked(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = read_panel_tables(spark, FOLDER)
    assert "BroadcastHashJoin" in plan_of(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = read_panel_tables(spark, FOLDER)
        assert "Broadcast" not in plan_of(large) and "SortMergeJoin" in plan_of(large)
        naive = training_run.naive_predictions(large, 365)
        assert naive.count() == training_run.naive_predictions(small, 365).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_hot_part_is_split_by_adaptive_execution(spark):
    """A part that holds most line items gets several tasks, and no row is lost."""
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    hot_key = read("part").agg(F.min("p_partkey")).first()[0]
    hot = read("lineitem").withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 > 0, hot_key).otherwise(F.col("l_partkey")))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        spread = hot.repartition(24)
        df = panel_from_tables(spread, read("supplier"), read("part"))
        total = sum(r.sales for r in df.collect())
        assert total == hot.agg(F.sum("l_quantity")).first()[0]
        assert "skew=true" in plan_of(df)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_percentiles_sort_only_the_ranges_that_hold_them(spark):
    """Of 64 ranges of a column with many values, the rows of at most four are ranked for two points."""
    values = spark.range(200_000).select((F.col("id") * 7919 % 200_003 / 8).alias("x"))
    counts = quantiles.value_counts(values, "x")
    found = quantiles.percentiles(counts, [10, 90.5])
    plan = plan_of(found)
    before_window = plan[plan.index("Window [") :]
    ranges = re.search(r"\bIN \(([\d,]+)\)", before_window).group(1).split(",")
    assert 1 <= len(ranges) <= 4 and "Cartesian" not in plan and "NestedLoop" not in plan
    exact = values.agg(F.percentile("x", [0.1, 0.905]).alias("v")).first().v
    assert [r.value for r in found.orderBy("p").collect()] == pytest.approx(exact)
