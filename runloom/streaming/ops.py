"""Streams of metric samples and application statuses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.functions.metric_rules import DEFAULT_RULES, MetricRule
from runloom.operators.metrics import gauge_rollup, normalize_metrics
from runloom.operators.status import latest_phase
from runloom.sources import sinks


def stream_metrics(lines: DataFrame, rules: Sequence[MetricRule] = DEFAULT_RULES,
                   width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Normalised gauges rolled up per window; samples later than ``lateness`` are dropped."""
    # The watermark comes first: every line moves it on, whether or not a rule takes it.
    timed = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return gauge_rollup(normalize_metrics(timed, rules), width)


def upsert_batches(changes: DataFrame, out_path: str, checkpoint: str, keys: Sequence[str],
                   every: str | None = "1 minute", merge_every: int = 100) -> StreamingQuery:
    """Write the changed rows of each micro-batch into a folder named by its number.

    A batch that is repeated after a failure replaces its own folder. ``read_changes`` finds the rows; of
    several rows of one key, that of the highest batch counts. Every ``merge_every`` batches those before
    are merged, so there are never more folders than twice that many.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % merge_every == 0:
            merge_batches(batch.sparkSession, out_path, batch_id, keys)
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (changes.writeStream.outputMode("update").trigger(**trigger)
            .option("checkpointLocation", checkpoint).foreachBatch(upsert).start())


def read_changes(spark: SparkSession, out_path: str, before: int | None = None) -> DataFrame:
    """The rows of the newest merged folder and of all whole batches after it, with their ``batch``.

    A merged row has the number of the last batch that was merged. With ``before`` only batches below it.
    """
    merged = [n for n in sinks.published(spark, out_path, "merged") if before is None or n < before]
    first = merged[-1] if merged else 0
    batches = [n for n in sinks.published(spark, out_path, "batch")
               if n >= first and (before is None or n < before)]
    parts = [spark.read.parquet(f"{out_path}/{folder}").withColumn("batch", F.lit(n))
             for folder, n in ([(f"merged={first}", first - 1)] if merged else [])
             + [(f"batch={n}", n) for n in batches]]
    if not parts:
        raise FileNotFoundError(f"nothing is written at {out_path}")
    return reduce(DataFrame.unionByName, parts)


def merge_batches(spark: SparkSession, out_path: str, before: int, keys: Sequence[str]) -> None:
    """Merge all batches below ``before`` into the folder ``merged=before``.

    Nothing that a reader may be at goes: the new folder counts once it is whole, and what it replaces
    stays until the next merge; only what the merge before has replaced is deleted. May be repeated at
    any point.
    """
    rows = read_changes(spark, out_path, before)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_newest"))
    (newest.select(*keys, *[F.col("_newest")[c].alias(c) for c in rest])
     .write.mode("overwrite").parquet(f"{out_path}/merged={before}"))
    earlier = [n for n in sinks.published(spark, out_path, "merged") if n < before]
    if earlier:
        for n in sinks.published(spark, out_path, "batch"):
            if n < earlier[-1]:
                sinks.remove(spark, f"{out_path}/batch={n}")
        for n in earlier[:-1]:
            sinks.remove(spark, f"{out_path}/merged={n}")


def stream_latest_phase(events: DataFrame, out_path: str, checkpoint: str, key: Sequence[str],
                        every: str | None = "1 minute", **columns) -> StreamingQuery:
    """Keep the newest phase of each key up to date below ``out_path``, for ``read_latest_phase``.

    The state holds one record per key. ``every=None`` takes in what is there and stops.
    """
    return upsert_batches(latest_phase(events, key, **columns), out_path, checkpoint, key, every)


def read_latest_phase(spark: SparkSession, out_path: str, key: Sequence[str]) -> DataFrame:
    """The newest phase of each key: of several records, that of the highest batch."""
    changes = read_changes(spark, out_path)
    return (changes.groupBy(*key)
            .agg(F.max_by(F.struct("phase", "since"), "batch").alias("_newest"))
            .select(*key, F.col("_newest.phase").alias("phase"),
                    F.col("_newest.since").alias("since")))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is now into Parquet files, and return them as a table."""
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).format("parquet").start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_once_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The same in one micro-batch, for state with clock times: those streams never run out of batches."""
    query = (stream.writeStream.outputMode("append").trigger(once=True)
             .option("checkpointLocation", checkpoint).format("parquet").start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The same for results that are rewritten whole by every micro-batch (complete mode)."""
    query = (stream.writeStream.outputMode("complete").trigger(availableNow=True)
             .option("checkpointLocation", checkpoint)
             .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
             .start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
