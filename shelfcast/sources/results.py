"""Storing metric tables and fitted models, and finding them again."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the three stored result tables.
RESULT_TABLES = ("01_ml_models_comparison", "02_all_models_comparison", "03_lstm_model_comparison")

_METRICS_SCHEMA = "model STRING, rmse DOUBLE, mae DOUBLE, r2 DOUBLE, mape DOUBLE, smape DOUBLE"


def feature_fingerprint(spark: SparkSession, features: Sequence[str]) -> str:
    """First ten hex digits of the md5 of the feature names joined by ``|``."""
    digest = F.substring(F.md5(F.concat_ws("|", *map(F.lit, features))), 1, 10)
    return spark.range(1).select(digest.alias("digest")).first().digest


def output_root(spark: SparkSession, base: str, features: Sequence[str]) -> str:
    return f"{base.rstrip('/')}/feat_{feature_fingerprint(spark, features)}"


def feature_digest(features: Sequence[str]) -> str:
    """``feature_fingerprint`` without a session."""
    return hashlib.md5("|".join(features).encode()).hexdigest()[:10]


def data_fingerprint(panel: DataFrame) -> str:
    """First ten hex digits of the md5 of row count, first and last date, units sold and summed row hashes."""
    facts = panel.agg(
        F.concat_ws(
            "|",
            F.count("*"),
            F.min("date"),
            F.max("date"),
            F.sum("sales"),
            F.sum(F.xxhash64(*sorted(panel.columns)).cast("decimal(38,0)")),
        ).alias("facts")
    )
    return facts.select(F.substring(F.md5("facts"), 1, 10).alias("digest")).first().digest


def estimator_fingerprint(estimator: Estimator) -> str:
    """First ten hex digits of the md5 of an estimator's class and parameters."""
    values = sorted(f"{param.name}={value}" for param, value in estimator.extractParamMap().items())
    return hashlib.md5("|".join([type(estimator).__name__, *values]).encode()).hexdigest()[:10]


def write_metrics(metrics: DataFrame, root: str, name: str, fmt: str = "csv") -> None:
    """Metric tables have one row per model, so one file is enough."""
    writer = metrics.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(f"{root}/{name}")
    else:
        writer.format(fmt).save(f"{root}/{name}")


def read_metrics(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The stored table, or None when it was never written."""
    try:
        return spark.read.schema(_METRICS_SCHEMA).option("header", True).csv(f"{root}/{name}")
    except AnalysisException:
        return None


def read_all_metrics(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """All three tables, or None unless every one is there."""
    tables = {name: read_metrics(spark, root, name) for name in RESULT_TABLES}
    return None if any(t is None for t in tables.values()) else tables


def save_model(model: PipelineModel, root: str, name: str) -> None:
    model.write().overwrite().save(f"{root}/models/{name}")


def load_model(spark: SparkSession, root: str, name: str) -> PipelineModel | None:
    path = f"{root}/models/{name}"
    try:
        spark.read.text(f"{path}/metadata").limit(1)
    except AnalysisException:
        return None
    return PipelineModel.load(path)


def save_scaler(parameters: DataFrame, root: str, name: str) -> None:
    parameters.write.mode("overwrite").parquet(f"{root}/scalers/{name}")


def load_scaler(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/scalers/{name}")
    except AnalysisException:
        return None
