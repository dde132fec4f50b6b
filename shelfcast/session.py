"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A broadcast happens only when Spark's own size estimate, or the size measured
# at run time by adaptive execution, is below the session's threshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stack traces for every Column make wide plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Shuffle partitions of about this size; adaptive execution merges those that turn out small and splits skewed ones.
PARTITION_BYTES = 128 * 1024 * 1024
# The driver tracks a block for each pair of map task and partition, so their number has a ceiling of a few ten thousand.
PARTITIONS = (200, 20_000)


def shuffle_partitions_for(shuffled_bytes: int) -> int:
    """Partition count for the rows that are shuffled: here those after the map-side sums, not the raw input."""
    return min(max(PARTITIONS[0], math.ceil(shuffled_bytes / PARTITION_BYTES)), PARTITIONS[1])


def build_session(app: str = "shelfcast", shuffled_bytes: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution; ``shuffled_bytes`` sizes the largest shuffle of a run.

    Adaptive execution starts every shuffle with that many partitions and merges them to the size that the shuffle has.
    """
    sized = {} if shuffled_bytes is None else {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_partitions_for(shuffled_bytes))}
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **sized, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Without that setting it is a folder of the warehouse, which executors share as well.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shelfcast-scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted on leaving; results must be computed by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete_path(spark, path)
        del _made[before:]


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage: the rows do not change if an executor is lost, and Spark
    knows the table's size when it decides about a broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
