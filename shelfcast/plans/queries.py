"""Registered queries: each takes a session and a folder of Parquet tables.

Doubles are rounded here, and arrays are written as text, only to make results
comparable with another engine; the operators return them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import SERIES, SERIES_DAY
from shelfcast.functions.calendar import day_name, iso_date, month_name, one_hot_calendar, with_calendar, with_holiday_flag
from shelfcast.operators import autocorr, forecast, profile, quantiles, regressors, scaling, scoring, splits
from shelfcast.operators.codes import category_codes, with_global_position
from shelfcast.operators.features import (
    FEATURES,
    HORIZONS,
    complete_rows,
    feature_frame,
    lookback_sequences,
    with_lags,
    with_position,
    with_rolls,
)
from shelfcast.operators.series_models import chosen_penalty_ridge, per_series_ridge
from shelfcast.plans import horizon_study, profile_study, training_run
from shelfcast.session import materialize, scratch_path, shared_dir
from shelfcast.sources import results
from shelfcast.sources.panel import as_panel, densify, read_panel_tables, scan_csv, write_panel
from shelfcast.sources.panel import undated_rows as count_undated

Query = Callable[[SparkSession, str], DataFrame]

VAL_DAYS = splits.LONG_VAL_DAYS
SLICE_ITEM = "PROMO"

# The tables span 1995 to 2001, so the queries mark four fixed-date holidays of those years.
HOLIDAYS = tuple(f"{year}-{day}" for year in range(1995, 2002) for day in ("01-01", "07-04", "11-11", "12-25"))

_REGISTRY: dict[str, Query] = {}


def query(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function of the panel under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(build(read_panel_tables(spark, folder)))

    _REGISTRY[build.__name__] = run
    return build


def query_on_stored_panel(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function that passes over the panel several times: the panel is
    written to the shared folder first, so the raw tables are read once."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(build(materialize(read_panel_tables(spark, folder), "panel")))

    _REGISTRY[build.__name__] = run
    return build


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six digits; adding zero turns -0.0 into 0.0."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in doubles}) if doubles else df


def _text(array: str):
    return F.array_join(F.col(array).cast("array<string>"), ",")


# Panel and features


@query
def panel(p):
    return p


@query
def densified_panel(p):
    return densify(p)


@query
def calendar_features(p):
    named = with_calendar(p).withColumns({"day_label": day_name(F.col("dow")), "month_label": month_name(F.col("month"))})
    return named.withColumn("iso", iso_date(F.col("date")))


@query
def holiday_flag(p):
    return with_holiday_flag(p, HOLIDAYS)


@query
def one_hot_calendar_columns(p):
    return one_hot_calendar(p)


@query
def log_sales(p):
    return p.withColumn("log_sales", F.log1p("sales"))


@query
def series_position(p):
    return with_position(p)


@query
def lag_features(p):
    return with_lags(p)


@query
def rolling_features(p):
    return with_rolls(p)


@query
def training_frame(p):
    return training_run.training_frame(p).select("date", *SERIES, "sales", *FEATURES)


@query_on_stored_panel
def category_code_table(p):
    complete = complete_rows(with_lags(p))
    items = category_codes(complete, "item", "code").select(F.lit("item").alias("kind"), F.col("item").alias("label"), "code")
    stores = category_codes(complete, "store", "code").select(
        F.lit("store").alias("kind"), F.col("store").cast("string").alias("label"), "code"
    )
    return items.unionByName(stores)


@query
def global_position(p):
    return with_global_position(p, ["date", *SERIES])


@query
def lookback_sequence_samples(p):
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    return lookback_sequences(split).select(*SERIES_DAY, "split", _text("seq").alias("seq"), "y")


@query
def lookback_across_split(p):
    split = splits.with_time_split(complete_rows(with_lags(p)), splits.VAL_DAYS)
    return lookback_sequences(split, across_split=True).select(*SERIES_DAY, "split", _text("seq").alias("seq"), "y")


@query
def direct_horizon_windows(p):
    inputs = [_text(f"x.{name}").alias(f"x_{name}") for name in horizon_study.INPUTS]
    return horizon_study.windows(p, HOLIDAYS).select(*SERIES, "anchor_date", "horizon", "i", "n", "y", "split", *inputs)


# Splits, selections and scalers


@query
def time_split_counts(p):
    split = splits.with_time_split(complete_rows(with_lags(p)))
    return split.groupBy("split", "cutoff").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query
def ratio_split_counts(p):
    return horizon_study.windows(p, HOLIDAYS).groupBy("horizon", "split").agg(F.count("*").alias("n_windows"))


@query
def long_enough_series(p):
    return profile.series_sizes(splits.min_length(p, 395))


@query_on_stored_panel
def first_ten_series(p):
    return profile.series_sizes(splits.first_series(p, 10))


@query
def single_series(p):
    return splits.one_series(p, 1, SLICE_ITEM)


@query
def trailing_row_windows(p):
    return splits.trailing_rows(p)


@query
def trailing_calendar_windows(p):
    return splits.trailing_calendar(p)


@query
def largest_pairs(p):
    return splits.largest_pairs(p)


@query_on_stored_panel
def chosen_pair_rows(p):
    return training_run.chosen_pair_frame(p, VAL_DAYS).select(*SERIES_DAY, "store_code", "item_code", "sales")


SCALED = ["sales", "lag_1", "lag_7", "roll_mean_7", "roll_std_28"]


@query_on_stored_panel
def standard_scale(p):
    split = splits.with_time_split(complete_rows(feature_frame(p)), VAL_DAYS)
    fitted = scaling.fit_standard(split.where("split = 'train'"), SCALED)
    return scaling.scale_standard(split, fitted, SCALED).select(*SERIES_DAY, "split", *SCALED)


@query
def standard_scaler_parameters(p):
    split = splits.with_time_split(complete_rows(feature_frame(p)), VAL_DAYS)
    return scaling.fit_standard(split.where("split = 'train'"), SCALED)


@query_on_stored_panel
def standard_scale_round_trip(p):
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    fitted = scaling.fit_standard(split.where("split = 'train'"), ["sales"]).first()
    scaled = scaling.scale_standard(split, fitted, ["sales"])
    return scaling.unscale_standard(scaled, fitted, "sales", "sales").select(*SERIES_DAY, "split", "sales")


@query
def minmax_scale_per_series(p):
    frame = horizon_study.study_frame(p, HOLIDAYS)
    return scaling.scale_minmax(frame, horizon_study.INPUTS)


@query
def minmax_round_trip(p):
    scaled = scaling.scale_minmax(p, ["sales"], keep_range=True)
    return scaling.unscale_minmax(scaled, "sales", "sales").select("date", *SERIES, "sales")


# Profile


@query
def dataset_overview(p):
    return profile.dataset_overview(p)


@query
def null_counts(p):
    return profile.null_counts(p)


@query_on_stored_panel
def sales_moments(p):
    return profile.moments(p)


@query
def sales_percentiles(p):
    return profile.sales_percentiles(p)


@query
def sales_histogram(p):
    return profile.sales_histogram(p)


@query
def log_sales_histogram(p):
    return profile.sales_histogram(p, log=True)


@query
def boxplot_stats(p):
    return quantiles.box_plot(profile.stored_counts(p, "sales"))


@query
def weekday_profile(p):
    return profile.weekday_profile(p)


@query
def month_profile(p):
    return profile.month_profile(p)


@query
def daily_mean(p):
    return profile.daily_mean(p)


@query
def store_totals_top10(p):
    return profile.top_stores(p)


@query
def item_volatility_top10(p):
    return profile.top_volatile_items(p)


@query
def key_counts(p):
    return profile.key_counts(p)


@query
def sorted_store_counts(p):
    return profile.sorted_counts(p, "store")


@query
def store_count_histogram(p):
    return profile.key_count_histogram(p, ["store"], profile.KEY_BINS)


@query
def item_count_histogram(p):
    return profile.key_count_histogram(p, ["item"], profile.KEY_BINS)


@query
def pair_count_histogram(p):
    return profile.key_count_histogram(p, SERIES, profile.PAIR_BINS)


@query
def item_store_totals(p):
    return profile.item_store_totals(p, SLICE_ITEM)


@query
def extremes(p):
    return profile.extremes(p)


# Tables of the whole profile, which share one stored panel and one table of value counts.


def _from_profile_study(table: str) -> Callable[[DataFrame], DataFrame]:
    def build(p: DataFrame) -> DataFrame:
        return profile_study.run(p)[table]

    return build


for _table in ("overview", "percentiles", "log_histogram", "box_plot", "key_counts", "extremes"):
    _build = _from_profile_study(_table)
    _build.__name__ = f"profile_study_{_table}"
    query(_build)


# Autocorrelation


@query
def acf(p):
    return autocorr.acf(autocorr.correlation_arrays(p))


@query
def pacf(p):
    return autocorr.pacf(autocorr.correlation_arrays(p))


@query_on_stored_panel
def acf_of_largest_pairs(p):
    chosen = splits.rows_of(p, splits.largest_pairs(p, 3).orderBy(F.desc("n_rows"), *SERIES).limit(2))
    return autocorr.acf(autocorr.correlation_arrays(chosen))


@query
def panel_acf(p):
    return autocorr.acf(autocorr.panel_correlation_array(p))


@query
def panel_pacf(p):
    return autocorr.pacf(autocorr.panel_correlation_array(p))


# Scores


@query
def naive_metrics(p):
    return scoring.score(training_run.naive_predictions(p, VAL_DAYS))


@query
def naive_metrics_densified(p):
    return scoring.score(training_run.naive_predictions(densify(p), VAL_DAYS))


@query
def smoothed_percentage_errors(p):
    return scoring.smoothed_percentage_errors(training_run.naive_predictions(p, VAL_DAYS))


@query
def metrics_by_window(p):
    return scoring.score_trailing(training_run.naive_predictions(p, VAL_DAYS))


@query
def timeline_summary(p):
    return scoring.timeline_summary(training_run.naive_predictions(p, VAL_DAYS))


@query
def metric_ranking(p):
    return scoring.rank_models(scoring.score(training_run.naive_predictions(p, VAL_DAYS)))


@query
def best_per_metric(p):
    return scoring.best_per_metric(scoring.score(training_run.naive_predictions(p, VAL_DAYS)))


@query_on_stored_panel
def common_key_ranking(p):
    """Models that cover different rows are compared on the rows they share."""
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    full = scoring.long_predictions(split.where("split = 'val'"), {"row_7_back": "lag_7"})
    sampled = lookback_sequences(split).where("split = 'val'")
    mean = F.aggregate("seq", F.lit(0.0), lambda acc, v: acc + v) / F.size("seq")
    fewer = scoring.long_predictions(sampled.withColumn("seq_mean", mean), {"sequence_mean": "seq_mean"})
    return scoring.rank_models(scoring.score(scoring.on_common_keys(scoring.combine(full, fewer), 2)))


@query_on_stored_panel
def combined_results(p):
    """Two result tables, from different model families, joined into one ranking."""
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    rows = scoring.long_predictions(split.where("split = 'val'"), {"last_row": "lag_1", "row_60_back": "lag_60"})
    trend = forecast.trend_fitted(
        p.withColumn("cutoff", splits.cutoff_date(complete_rows(with_lags(p)), VAL_DAYS)),
        fit_rows=F.col("date") <= F.col("cutoff"),
    )
    later = trend.join(split.where("split = 'val'").select(*SERIES_DAY), list(SERIES_DAY), "left_semi")
    return scoring.rank_models(scoring.combine(scoring.score(rows), scoring.score(later)))


@query_on_stored_panel
def chosen_pair_scores(p):
    """Trailing scores of one series: the wanted pair of codes, or its fallback."""
    chosen = training_run.chosen_pair_frame(p, VAL_DAYS)
    return scoring.score_trailing(scoring.long_predictions(chosen, training_run.NAIVE_MODELS), by=("model", *SERIES))


@query_on_stored_panel
def horizon_matrix(p):
    matrix = horizon_study.backtest_matrix(p)
    names = dict(zip(scoring.MATRIX_HORIZONS, ("historical", "month_1", "months_3", "year_1")))
    return matrix.withColumnsRenamed(names)


@query
def macro_metrics(p):
    predictions = horizon_study.window_baselines(horizon_study.windows(p, HOLIDAYS))
    return horizon_study.evaluate(predictions, SLICE_ITEM)[0]


@query
def results_matrix(p):
    predictions = horizon_study.window_baselines(horizon_study.windows(p, HOLIDAYS))
    matrix = horizon_study.evaluate(predictions, SLICE_ITEM)[1]
    return matrix.toDF(*(c.replace(" ", "_") for c in matrix.columns))


# Forecasts


def _last_date(p: DataFrame):
    return p.agg(F.max("date")).scalar()


@query_on_stored_panel
def persistence_forecast(p):
    return forecast.persistence(training_run.naive_predictions(p, VAL_DAYS, {"row_7_back": "lag_7"}), _last_date(p))


@query
def linear_trend_fit(p):
    return forecast.fit_trend(p)


@query
def linear_trend_path(p):
    return forecast.trend_path(p)


@query
def trend_backtest(p):
    return forecast.backtest(p, horizon_study.BACKTEST_HORIZONS, forecast.extend_trend)


@query
def holt_winters(p):
    return forecast.seasonal_smoothing(p)


@query
def holt_winters_optimised(p):
    return forecast.optimised_smoothing(p)


@query_on_stored_panel
def recursive_mean_forecast(p):
    """Sales regressed on the mean of the seven rows before; the forecast feeds on itself."""
    fit = complete_rows(feature_frame(p)).agg(
        F.struct(F.regr_slope("sales", "roll_mean_7").alias("b"), F.regr_intercept("sales", "roll_mean_7").alias("a")).alias("f")
    )
    ready = forecast.latest_sequence(p, 7).withColumn("f", fit.scalar())
    return forecast.recursive_forecast(ready, F.array_repeat(F.col("f.b") / 7, 7), F.col("f.a"), model="recursive_mean")


# Sources and sinks


def csv_panel_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written as CSV and scanned with a fixed schema; items become their codes."""
    p = read_panel_tables(spark, folder)
    path = scratch_path(spark, "panel-csv")
    coded = p.join(category_codes(p, "item"), "item").select("date", "store", F.col("item_code").alias("item"), "sales")
    coded.write.option("header", True).csv(path)
    return as_panel(scan_csv(spark, path))


def parquet_panel_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    write_panel(read_panel_tables(spark, folder), path)
    return spark.read.parquet(path)


def metrics_written_and_read(spark: SparkSession, folder: str) -> DataFrame:
    """Three different tables, so that none may be taken for another."""
    root = scratch_path(spark, "metrics")
    metrics = materialize(scoring.score(training_run.naive_predictions(read_panel_tables(spark, folder), VAL_DAYS)), "scores")
    for name, part in zip(results.RESULT_TABLES, ("model LIKE 'row%'", "true", "model LIKE 'mean%'")):
        results.write_metrics(metrics.where(part), root, name)
    tables = results.read_all_metrics(spark, root)
    found = [tables[name].withColumn("stored_as", F.lit(name)) for name in results.RESULT_TABLES]
    return tidy(found[0].unionByName(found[1]).unionByName(found[2]))


def undated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV in which a rule spoils dates: rows with and without one."""
    p = read_panel_tables(spark, folder)
    path = scratch_path(spark, "spoilt-csv")
    spoilt = F.when(F.dayofmonth("date") == 13, F.concat(F.year("date").cast("string"), F.lit("-13-40"))).otherwise(F.col("date").cast("string"))
    p.select(spoilt.alias("date"), "store", F.length("item").alias("item"), "sales").write.option("header", True).csv(path)
    return count_undated(scan_csv(spark, path))


# Regressors, all at full size.

# Whether a model fitted in this session on the same rows may be loaded by another query.
REUSE_MODELS = True


def _split_frame(p: DataFrame) -> DataFrame:
    """The split training frame, written once to the shared folder."""
    return training_run.stored_frame(p, scratch_path(p.sparkSession, "study"), VAL_DAYS)


def _fit(p: DataFrame, names) -> DataFrame:
    """Predictions of full-size models. Each is fitted once in a session for the same panel and hold-out."""
    root = training_run.study_root(p, f"{shared_dir(p.sparkSession)}/models-{p.sparkSession.sparkContext.applicationId}", VAL_DAYS)
    estimators = {name: regressors.REGRESSORS[name]() for name in names}
    return regressors.fit_all(_split_frame(p), estimators, root=root if REUSE_MODELS else None)[0]


def _regressor(name: str) -> Callable[[DataFrame], DataFrame]:
    def build(p: DataFrame) -> DataFrame:
        return _fit(p, [name])

    return build


for _query_name, _model in {
    "linear_regression": "LinearRegression",
    "decision_tree": "DecisionTree",
    "random_forest": "RandomForest",
    "extra_trees": "ExtraTrees",
    "gradient_boosting": "GradientBoosting",
    "hist_gradient_boosting": "HistGradientBoosting",
}.items():
    _build = _regressor(_model)
    _build.__name__ = _query_name
    query_on_stored_panel(_build)


@query_on_stored_panel
def linear_regression_on_one_lag(p):
    """One input only, so that the fitted line has a closed form to compare with."""
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    predictions, _ = regressors.fit_all(split, {"LinearRegression": regressors.linear_regression()}, ["lag_7"])
    return predictions


@query_on_stored_panel
def direct_linear_by_horizon(p):
    """A line from today's sales to the sales 30, 90 and 365 rows ahead."""
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    targeted = regressors.with_direct_targets(split, HORIZONS)
    return regressors.fit_direct(targeted, regressors.linear_regression(), HORIZONS, "direct_linear", ["sales"])


@query
def direct_boosting_by_horizon(p):
    targeted = regressors.with_direct_targets(_split_frame(p), HORIZONS)
    return regressors.fit_direct(targeted, regressors.gradient_boosting(), HORIZONS, "direct_boosting")


@query_on_stored_panel
def regressor_ranking(p):
    return scoring.rank_models(scoring.score(_fit(p, regressors.REGRESSORS)))


# Models whose answer has a closed form, beside the full ones: they show that rows, labels and keys go where they belong.


def _lagged_split(p: DataFrame) -> DataFrame:
    return materialize(splits.with_time_split(complete_rows(feature_frame(p)), VAL_DAYS), "lagged")


def _weekday_levels(split: DataFrame) -> DataFrame:
    """Sales replaced by the training mean of their weekday, which is then a function of the one input."""
    means = split.where("split = 'train'").groupBy("dow").agg(F.avg("sales").alias("level"))
    return split.join(means, "dow").withColumn("sales", F.col("level")).drop("level")


def _on_weekday(name: str, estimator, levels: bool) -> Callable[[DataFrame], DataFrame]:
    def build(p: DataFrame) -> DataFrame:
        split = _lagged_split(p)
        return regressors.fit_all(_weekday_levels(split) if levels else split, {name: estimator()}, ["dow"])[0]

    return build


# A tree that splits on the weekday alone gives the weekday's mean. Where rows are drawn at random, the target is that mean itself.
WEEKDAY_MODELS = {
    "decision_tree_on_weekday": ("DecisionTree", regressors.decision_tree, False),
    "extra_trees_on_weekday": ("ExtraTrees", regressors.extra_trees, False),
    "hist_gradient_boosting_on_weekday": ("HistGradientBoosting", regressors.hist_gradient_boosting, False),
    "random_forest_on_weekday_levels": ("RandomForest", regressors.random_forest, True),
    "gradient_boosting_on_weekday_levels": ("GradientBoosting", lambda: regressors.gradient_boosting(depth=6), True),
}
for _query_name, _arguments in WEEKDAY_MODELS.items():
    _build = _on_weekday(*_arguments)
    _build.__name__ = _query_name
    query_on_stored_panel(_build)


@query_on_stored_panel
def hist_gradient_boosting_on_weekend(p):
    """Five rounds on the weekend flag: each takes the same share, less the penalty's part, of what is left of both means."""
    model = {"HistGradientBoosting": regressors.hist_gradient_boosting(5)}
    return regressors.fit_all(_lagged_split(p), model, ["is_weekend"])[0]


@query_on_stored_panel
def early_stopping_on_weekday_levels(p):
    """The loss falls as long as there is one to fall, so no round is given up early."""
    levels = materialize(_weekday_levels(_lagged_split(p)), "levels")
    return regressors.fit_with_early_stop(levels, regressors.early_stopping_boosting(depth=6), "EarlyStoppingBoosting", ["dow"])[0]


@query_on_stored_panel
def regressor_ranking_on_one_input(p):
    """A line and a tree on the weekday, scored and ranked."""
    models = {"LinearRegression": regressors.linear_regression(), "DecisionTree": regressors.decision_tree()}
    return scoring.rank_models(scoring.score(regressors.fit_all(_lagged_split(p), models, ["dow"])[0]))


@query_on_stored_panel
def saved_model_predictions(p):
    """A fitted line is saved, loaded and asked again."""
    split = _lagged_split(p)
    root = scratch_path(p.sparkSession, "saved")
    model = {"LinearRegression": regressors.linear_regression()}
    _, fitted = regressors.fit_all(split, model, ["lag_7"], root=root)
    loaded = results.load_model(p.sparkSession, root, regressors.stored_name("LinearRegression", model["LinearRegression"], ["lag_7"]))
    return regressors.predict(loaded, regressors.with_label(split).where("split = 'val'"), "LinearRegression")


def _tables_of_fitted_line(p: DataFrame) -> tuple[DataFrame, ...]:
    split = _lagged_split(p)
    predictions, _ = regressors.fit_all(split, {"LinearRegression": regressors.linear_regression()}, ["lag_7"])
    return training_run.tables_of(materialize(predictions, "predictions"))


@query_on_stored_panel
def fitted_run_by_window(p):
    """Metrics of a fitted model over the last rows of each series."""
    return _tables_of_fitted_line(p)[0]


@query_on_stored_panel
def fitted_run_timeline(p):
    return _tables_of_fitted_line(p)[1]


@query_on_stored_panel
def fitted_run_best(p):
    return _tables_of_fitted_line(p)[2]


@query_on_stored_panel
def fitted_run_forecasts(p):
    """The newest prediction of a fitted model, held for a year."""
    return _tables_of_fitted_line(p)[3]


@query_on_stored_panel
def sequence_of_exact_line(p):
    """A target that is a line of the newest value in the sequence and of the weekday is found again."""
    samples = lookback_sequences(splits.with_time_split(complete_rows(feature_frame(p)), VAL_DAYS))
    exact = samples.withColumn("y", 2 * F.element_at("seq", -1) + 3 * F.col("dow") + 5)
    found = regressors.fit_sequence_model(exact, regressors.linear_regression(), "SequenceLinear", ["dow"])[0]
    return found.withColumn("yhat", F.round("yhat", 3))


@query_on_stored_panel
def sequences_over_null_sales(p):
    """Sales blanked by a rule: sequences that would hold a NULL are left out, the others keep their places."""
    blank = F.when((F.dayofyear("date") % 97 == 0), None).otherwise(F.col("sales"))
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS).withColumn("sales", blank)
    found = lookback_sequences(split)
    return found.select(*SERIES_DAY, "split", _text("seq").alias("seq"), "y")


@query_on_stored_panel
def recursive_line_on_one_lag(p):
    """A line on the row before, fitted by Spark ML and rolled forward."""
    split = splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)
    train = regressors.with_label(split).where("split = 'train'").select("lag_1", "y")
    line = regressors.as_pipeline(regressors.linear_regression(), ["lag_1"]).fit(train).stages[-1]
    found = forecast.recursive_forecast(forecast.latest_sequence(p, 1), list(line.coefficients), float(line.intercept))
    return found.withColumn("yhat", F.round("yhat", 4))


@query_on_stored_panel
def recursive_sequence_line(p):
    """A line on the row before and the last row's weekday, which stays fixed, rolled forward from the fitted scaler and model."""
    split = _lagged_split(p)
    samples = lookback_sequences(split, 1)
    _, model, scaler = regressors.fit_sequence_model(samples, regressors.linear_regression(), "SequenceLinear", ["dow"], 1)
    found = regressors.recursive_sequence_forecast(split, model, scaler.first(), "SequenceLinear", ["dow"], 1)
    return found.withColumn("yhat", F.round("yhat", 4))


@query
def recursive_sequence_huber(p):
    """The robust line on 28 rows and all features of the last row, rolled forward."""
    split = _split_frame(p)
    _, model, scaler = regressors.fit_sequence_model(lookback_sequences(split), regressors.huber_regression(), "SequenceHuber")
    return regressors.recursive_sequence_forecast(split, model, scaler.first(), "SequenceHuber")


@query
def sequence_huber(p):
    samples = lookback_sequences(_split_frame(p))
    return regressors.fit_sequence_model(samples, regressors.huber_regression(), "SequenceHuber")[0]


@query
def sequence_boosting(p):
    samples = lookback_sequences(_split_frame(p))
    return regressors.fit_sequence_model(samples, regressors.sequence_boosting(), "SequenceBoosting")[0]


@query
def early_stopping_boosting(p):
    estimator = regressors.early_stopping_boosting()
    return regressors.fit_with_early_stop(_split_frame(p), estimator, "EarlyStoppingBoosting")[0]


@query_on_stored_panel
def recursive_linear_forecast(p):
    """A linear model on the last 28 rows, fitted by Spark ML and rolled forward."""
    samples = regressors.with_label(lookback_sequences(splits.with_time_split(complete_rows(with_lags(p)), VAL_DAYS)))
    window = samples.select("split", "y", *(F.element_at("seq", i + 1).alias(f"s{i}") for i in range(28)))
    columns = [f"s{i}" for i in range(28)]
    model = regressors.as_pipeline(regressors.linear_regression(), columns).fit(window.where("split = 'train'")).stages[-1]
    return forecast.recursive_forecast(
        forecast.latest_sequence(p, 28), list(model.coefficients), float(model.intercept)
    )


@query
def per_series_ridge_predictions(p):
    return per_series_ridge(horizon_study.study_frame(p, HOLIDAYS))


@query
def ridge_penalty_on_one_input(p):
    """One row and one input, so that weights, errors and the chosen penalty have a closed form."""
    return chosen_penalty_ridge(horizon_study.study_frame(p, HOLIDAYS), 1, inputs=("sales",))


@query
def ridge_with_chosen_penalty(p):
    return chosen_penalty_ridge(horizon_study.study_frame(p, HOLIDAYS))


@query
def per_series_ridge_matrix(p):
    predictions = per_series_ridge(horizon_study.study_frame(p, HOLIDAYS))
    matrix = horizon_study.evaluate(predictions, SLICE_ITEM)[1]
    return matrix.toDF(*(c.replace(" ", "_") for c in matrix.columns))


_REGISTRY.update(
    csv_panel_scan=csv_panel_scan,
    undated_rows=undated_rows,
    parquet_panel_scan=parquet_panel_scan,
    metrics_written_and_read=metrics_written_and_read,
)


# Fits of hundreds of trees or rounds, which take minutes.
LONG = (
    "random_forest",
    "extra_trees",
    "gradient_boosting",
    "hist_gradient_boosting",
    "regressor_ranking",
    "early_stopping_boosting",
    "sequence_boosting",
    "direct_boosting_by_horizon",
)


def all_queries() -> dict[str, Query]:
    """All registered queries, the long ones last."""
    return {name: build for name, build in sorted(_REGISTRY.items(), key=lambda x: x[0] in LONG)}
