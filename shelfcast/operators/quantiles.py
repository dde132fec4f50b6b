"""Exact percentiles, histograms and box-plot statistics from value counts.

Repeated values are collapsed to (value, count) first, so that a value that holds a
third of all rows costs one row after the map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges that values are ranked in: at least so many, and one more for each so many distinct values.
RANGES = 64
VALUES_PER_RANGE = 1_000_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` for the non-null values."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    )


def percentiles(counts: DataFrame, points: Sequence[float]) -> DataFrame:
    """``(p, value)``: exact percentiles (0-100) with linear interpolation.

    Values are cut into ranges at approximate quantiles, so each range holds a similar
    number of distinct values whatever their spread. Their number follows the distinct values. The rows of each range say
    in which ones the asked ranks lie; only these are sorted, at most two for each point, each in a task of its own.
    """
    ranges = max(RANGES, counts.count() // VALUES_PER_RANGE)
    inner = [i / ranges for i in range(1, ranges)]
    # As many values as there are ranges, found once, so that both passes cut alike.
    cuts = counts.agg(F.percentile_approx("value", inner, 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    ranged = counts.select("value", "n", part.alias("part"))
    # One entry for each range.
    sizes = {r.part: r.size for r in ranged.groupBy("part").agg(F.sum("n").alias("size")).collect()}
    asked = _asked_ranks(sizes, points)
    wanted = ranged.where(F.col("part").isin(sorted({part for *_, part in asked})))
    ranked = wanted.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    spots = counts.sparkSession.createDataFrame(asked, "p double, share double, above boolean, rank bigint, part int")
    covers = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
    # Two rows for each point.
    found = ranked.join(F.broadcast(spots), "part").where(covers).groupBy("p", "share").agg(
        F.max(F.when(~F.col("above"), F.col("value"))).cast("double").alias("low"),
        F.max(F.when(F.col("above"), F.col("value"))).cast("double").alias("high"),
    )
    return found.select("p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value"))


def _asked_ranks(sizes: dict[int, int], points: Sequence[float]) -> list[tuple]:
    """For each point how far it lies between two neighbouring ranks, and each of both as a rank in a range and the range."""
    total, before, passed = sum(sizes.values()), {}, 0
    for part in sorted(sizes):
        before[part] = passed
        passed += sizes[part]
    out = []
    for p in dict.fromkeys(map(float, points)) if total else ():
        spot = p / 100 * (total - 1)
        for above, rank in ((False, math.floor(spot)), (True, math.ceil(spot))):
            part = max(k for k in before if before[k] <= rank)
            out.append((p, spot - math.floor(spot), above, rank - before[part], part))
    return out


def histogram(counts: DataFrame, bins: int, value: Column | None = None) -> DataFrame:
    """``(bin, lo, hi, n)`` for every one of ``bins`` equal-width bins, empty ones included.

    The last bin is closed. A single distinct value widens the range by 0.5 each way.
    A value that floating point puts on the wrong side of an edge is moved by one bin,
    so counts agree with the printed edges.
    """
    data = counts.select((F.col("value") if value is None else value).cast("double").alias("x"), "n")
    low, high = F.min("x"), F.max("x")
    flat = low == high
    limits = data.agg(
        F.struct(F.when(flat, low - 0.5).otherwise(low).alias("lo"), F.when(flat, high + 0.5).otherwise(high).alias("hi")).alias("r")
    )
    span = F.col("r.hi") - F.col("r.lo")
    edge = lambda i: F.when(i == bins, F.col("r.hi")).otherwise(i * (span / bins) + F.col("r.lo"))
    guess = F.least(F.floor((F.col("x") - F.col("r.lo")) / span * bins), F.lit(bins - 1))
    moved = (
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("x") >= edge(F.col("g") + 1)) & (F.col("g") < bins - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    filled = (
        data.withColumn("r", limits.scalar())
        .withColumn("g", guess)
        .withColumn("bin", moved.cast("int"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    frame = limits.select("r", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def box_plot(counts: DataFrame, reach: float = 1.5) -> DataFrame:
    """One row: quartiles, whiskers (extreme data within ``reach`` IQRs) and outlier count."""
    quartiles = percentiles(counts, (25, 50, 75)).agg(
        F.struct(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((25, "q1"), (50, "median"), (75, "q3")))).alias("q")
    )
    x, iqr = F.col("value"), F.col("q.q3") - F.col("q.q1")
    floor, ceiling = F.col("q.q1") - reach * iqr, F.col("q.q3") + reach * iqr
    inside = (x >= floor) & (x <= ceiling)
    return (
        counts.withColumn("q", quartiles.scalar())
        .agg(
            F.first("q").alias("q"),
            F.min(F.when(x >= floor, x)).alias("low"),
            F.max(F.when(x <= ceiling, x)).alias("high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
        .select(
            "q.q1",
            "q.median",
            "q.q3",
            F.least(F.col("low").cast("double"), F.col("q.q1")).alias("whisker_low"),
            F.greatest(F.col("high").cast("double"), F.col("q.q3")).alias("whisker_high"),
            "n_outliers",
        )
    )
