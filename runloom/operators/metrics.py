"""Metric samples: normalise lines, roll gauges up, turn counters into deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.metric_rules import (DEFAULT_RULES, LABELS, SEPARATOR, MetricRule,
                                            first_match, read_match)
from runloom.functions.times import packed_order
from runloom.operators.slices import MAX_ROWS, previous_values

SERIES = ["metric", "type", *LABELS]


def normalize_metrics(lines: DataFrame, rules: Sequence[MetricRule] = DEFAULT_RULES,
                      lowercase: bool = True, keep_unmatched: bool = False) -> DataFrame:
    """Replace ``line`` by metric name, type and label columns; lines without a rule are dropped."""
    others = [c for c in lines.columns if c != "line"]
    fields = F.split(first_match(F.col("line"), rules), SEPARATOR)
    # The fields come out of an explode, a missing match as no row (or, to keep it, a NULL). Filters
    # on them, here or in a later step, would otherwise be moved down past this projection and work
    # all patterns out a second time.
    found = F.array(fields) if keep_unmatched else F.array_compact(F.array(fields))
    matched = lines.select(*others, F.explode(found).alias("_match"))
    columns = read_match(F.col("_match"), lowercase)
    return matched.select(*others, *[columns[name].alias(name) for name in SERIES])


def label_map(metrics: DataFrame, out: str = "labels") -> DataFrame:
    """The label columns as one map that holds only labels with a value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.col(name).alias("value"))
                      for name in LABELS])
    present = F.filter(pairs, lambda pair: pair["value"].isNotNull())
    return metrics.withColumn(out, F.map_from_entries(present)).drop(*LABELS)


def gauge_rollup(metrics: DataFrame, width: str = "1 hour") -> DataFrame:
    """Last, lowest, highest and mean value of each gauge series per time bucket.

    Works on streams too (give them a watermark first). Equal times: the higher sample id is last.
    """
    return (metrics.where(F.col("type") == "GAUGE")
            .groupBy(*SERIES, F.window("ts", width).alias("_window"))
            .agg(F.max_by("value", packed_order(metrics, "ts", "sample_id")).alias("last_value"),
                 F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"),
                 F.avg("value").alias("avg_value"),
                 F.count("value").alias("samples"))
            .withColumn("bucket_start", F.col("_window.start"))
            .withColumn("bucket_end", F.col("_window.end"))
            .drop("_window"))


def counter_delta(metrics: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """What each counter sample adds to the one before it; after a reset, the new value itself.

    The first sample of a series has no delta.
    """
    counters = metrics.where(F.col("type") == "COUNTER")
    rows = previous_values(counters, SERIES, ["ts", "sample_id"], {"_previous": "value"}, max_rows)
    value, previous = F.col("value"), F.col("_previous")
    return (rows.withColumn("delta", F.when(value < previous, value).otherwise(value - previous))
            .withColumn("reset", F.coalesce(value < previous, F.lit(False)))
            .drop("_previous"))
