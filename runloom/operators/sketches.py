"""Tables of sketches: written once an hour, merged for any longer time without reading rows again.

A row of the table holds a count, a sketch of the distinct ids (HyperLogLog) and a sketch of the values'
distribution (KLL). Merged sketches have seen what all their rows together would have shown one sketch,
in whatever order and steps they are merged; both are bounded in size, whatever they have seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HyperLogLog keeps ids as they are up to 2^(LG_K - 3), then 2^LG_K registers.
LG_K = 14
# KLL keeps every value until there are about this many.
KLL_K = 2000


def distinct_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The relative error of a distinct count that is passed once in some hundred times only."""
    return deviations * 1.04 / math.sqrt(2**lg_k)


def hourly_sketches(events: DataFrame, keys: Sequence[str], ts: str, ids: str, values: str,
                    lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """Per key and hour: day, hour, rows, known values, ids sketch, values sketch.

    Aggregated in the tasks before the shuffle, so a hot key sends on one sketch per task. Null ids and
    null values are in no sketch.
    """
    hour = F.date_trunc("hour", ts)
    return events.groupBy(*keys, hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(values).alias("known"),
        F.hll_sketch_agg(ids, lg_k).alias("ids"),
        F.kll_sketch_agg_double(F.col(values).cast("double"), k).alias("spread"),
    ).withColumn("day", F.to_date("hour"))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Write the days that ``sketches`` holds; days written before are replaced, others stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def read_sketches(spark: SparkSession, path: str, first: str | None = None,
                  last: str | None = None) -> DataFrame:
    """The stored sketches of some days; only their partitions are opened."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with merged sketches, itself a table to be stored and merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("known").alias("known"),
        F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread").alias("spread"))


def estimates(merged: DataFrame, quantiles: dict[str, float], distinct: str = "distinct_ids") -> DataFrame:
    """The merged table with estimates in place of its sketches; quantiles of nothing are null."""
    sketches = {"ids", "spread"}
    columns = [c for c in merged.columns if c not in sketches]
    return merged.select(
        *columns, F.hll_sketch_estimate("ids").alias(distinct),
        *[F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("spread", F.lit(rank))).alias(name)
          for name, rank in quantiles.items()])
