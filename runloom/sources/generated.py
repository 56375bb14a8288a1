"""Repeatable sample points, and the sampling job that uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Odd multipliers that spread consecutive ids over 32 bits.
_SPREAD = {"x": 2654435761, "y": 2246822519}


def generated_ids(spark: SparkSession, n: int, slices: int | None = None) -> DataFrame:
    """``id`` from 0 to n - 1, generated inside the tasks."""
    return spark.range(0, n, 1, slices) if slices else spark.range(n)


def hashed_points(ids: DataFrame, id_col: str) -> DataFrame:
    """A point in the square from -1 to 1 for each id: the same on every run and retry."""
    low = F.pmod(F.col(id_col), F.lit(2 ** 31))
    return ids.select(*[
        (F.pmod(low * F.lit(m), F.lit(2 ** 32)).cast("double") / F.lit(2.0 ** 32) * 2 - 1)
        .alias(name) for name, m in _SPREAD.items()])


def pi_estimate(points: DataFrame) -> DataFrame:
    """Pi from the share of points inside the unit circle."""
    inside = F.count_if(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1)
    return (points.agg(F.count(F.lit(1)).alias("points"), inside.alias("inside"))
            .withColumn("pi", F.round(F.lit(4.0) * F.col("inside") / F.col("points"), 6)))
