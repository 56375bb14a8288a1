"""Joins that read and shuffle only what can find a partner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import open_session

# Partition values that are put into a filter at most; a table with more partitions is pruned by the
# planner alone.
MOST_VALUES = 10_000


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_broadcast_size(df: DataFrame) -> bool:
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= limit


def pruned_join(facts: DataFrame, side: DataFrame, on: Sequence[str], partition: str,
                most_values: int = MOST_VALUES) -> DataFrame:
    """Inner join of a partitioned table with a filtered side; partitions without partners stay closed.

    ``partition`` is the partition column of ``facts`` and one of ``on``. If the side is of a size to be
    broadcast, Spark prunes by the broadcast rows while the query runs. If it is larger, its distinct
    partition values, which are few where partitions are, become a filter of the scan first; with more
    than ``most_values`` of them nothing is pruned.
    """
    if not is_broadcast_size(side):
        rows = side.where(F.col(partition).isNotNull()).select(partition).distinct()
        values = [r[0] for r in rows.limit(most_values + 1).collect()]
        if len(values) <= most_values:
            facts = facts.where(F.col(partition).isin(values))
    return facts.join(side, list(on))


def filtering_session(spark: SparkSession, smallest_scan: str = "1GB",
                      largest_side: str = "1GB") -> SparkSession:
    """A session whose joins filter a large side by a Bloom filter of the selective one before its shuffle.

    Scans of ``smallest_scan`` or more are filtered, by sides of up to ``largest_side`` as planned. The
    filter has a fixed number of bits at most, so what is broadcast does not grow with the sides.
    """
    return open_session(spark, {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": smallest_scan,
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": largest_side,
    })
