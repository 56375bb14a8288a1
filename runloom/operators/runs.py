"""Schedules and their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.times import epoch_seconds, seconds, to_epoch
from runloom.operators.slices import (MAX_ROWS, SLICE, newest_per_key, previous_values,
                                      running, slice_hot_keys)

# Slots of a schedule that one row is spread into at most.
SLOTS_AT_ONCE = 10_000

# Stands for the end of a run that has none yet.
_NO_END = "9999-12-31 00:00:00"


def missed_slots(schedules: DataFrame, runs: DataFrame, t0: str, t1: str) -> DataFrame:
    """Slots of each schedule's time grid in [t0, t1) in which no run started.

    Slot n begins at t0 + n * every and is as long as the interval. Suspended schedules, and
    schedules without a positive interval, have no slots. ``t0`` and ``t1`` are timestamp texts.
    """
    kind = runs.schema["start"].dataType
    begin, until = F.lit(t0).cast(kind), F.lit(t1).cast(kind)
    first, last = to_epoch(begin, kind), to_epoch(until, kind)
    every = F.col("every_seconds")
    active = (schedules.where(~F.coalesce("suspend", F.lit(False)) & (every > 0))
              .select("schedule_id", "every_seconds"))
    # A fine grid over a long time is many slots: chunks of slots are dealt out before they are spread.
    slots = F.ceil((last - first) / every)
    chunks = (active.where(last > first)
              .withColumn("_chunk", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.floor((slots - 1) / SLOTS_AT_ONCE))))
              .repartition("schedule_id", "_chunk"))
    low = F.col("_chunk") * SLOTS_AT_ONCE
    grid = (chunks.withColumn("slot", F.explode(F.sequence(
        low, F.least(low + SLOTS_AT_ONCE, slots) - 1))).drop("_chunk"))
    # Distinct (schedule, slot) pairs are formed before the shuffle, so a schedule with very many
    # runs sends on no more rows than it has slots.
    started = (runs.where((F.col("start") >= begin) & (F.col("start") < until))
               .select("schedule_id", (epoch_seconds(runs, "start") - first).alias("_after"))
               .join(active, "schedule_id")
               .select("schedule_id", F.floor(F.col("_after") / every).alias("slot"))
               .distinct())
    return (grid.join(started, ["schedule_id", "slot"], "left_anti")
            .select("schedule_id", "slot",
                    (begin + seconds(F.col("slot") * every)).alias("slot_start")))


def overlapping_runs(runs: DataFrame, schedules: DataFrame,
                     max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs that began while an earlier run of their schedule was still going.

    A run that begins exactly when another ends does not overlap it; a run without end is still
    going. ``finding`` is set where the schedule forbids concurrent runs. Instead of comparing pairs
    of runs, each start is compared with the latest end so far.
    """
    kind = runs.schema["end"].dataType
    ends = runs.withColumn("_end", F.coalesce("end", F.lit(_NO_END).cast(kind)))
    seen = running(ends, ["schedule_id"], ["start", "run_id"], "_end", "max", "_latest",
                   include_current=False, max_rows=max_rows)
    late = seen.where(F.col("_latest") > F.col("start")).drop("_end", "_latest")
    policy = schedules.select(
        "schedule_id", F.coalesce("concurrency_policy", F.lit("Allow")).alias("policy"))
    return (late.join(policy, "schedule_id", "left")
            .withColumn("finding", F.coalesce(F.col("policy") == "Forbid", F.lit(False))))


def overlap_counts(overlaps: DataFrame) -> DataFrame:
    """Overlapping runs per schedule, and how many of them are findings."""
    return overlaps.groupBy("schedule_id", "policy").agg(
        F.count(F.lit(1)).alias("overlaps"),
        F.sum(F.col("finding").cast("long")).alias("findings"))


def retained_runs(runs: DataFrame, schedules: DataFrame) -> DataFrame:
    """The newest finished runs that each schedule's history limits keep, one of each by default."""
    limits = schedules.select(
        "schedule_id",
        F.coalesce("successful_limit", F.lit(1)).alias("_successful"),
        F.coalesce("failed_limit", F.lit(1)).alias("_failed"))
    highest = limits.agg(F.max(F.greatest("_successful", "_failed"))).first()[0] or 0
    outcome = F.col("outcome")
    limit = F.coalesce(F.when(outcome == "failed", F.col("_failed"))
                       .otherwise(F.col("_successful")), F.lit(1))
    key, order = ["schedule_id", "outcome"], ["start", "run_id"]
    # No schedule keeps more than the highest limit, so only so many runs meet the limits at all.
    finished = runs.where(outcome.isin("failed", "successful")).withColumn(
        "_limit", F.lit(max(highest, 1)))
    newest = newest_per_key(finished, key, order, "_limit", max(highest, 1)).drop("_limit")
    return newest_per_key(newest.join(limits, "schedule_id", "left").withColumn("_limit", limit)
                          .drop("_successful", "_failed"), key, order, "_limit",
                          max(highest, 1)).drop("_limit")


def number_chains(runs: DataFrame, policy: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Give every run the number of its retry chain within its schedule, and why it continues it.

    ``retry_type`` says what is retried: ``Never`` nothing, ``OnFailure`` (also if the type is missing)
    failed runs and failed submissions, ``Always`` successful runs too. A run continues the chain of
    the run before it if that one is retried and this one started within the interval after its end:
    the submission interval after a failed submission, else the retry interval. ``continues`` is
    ``submission`` or ``run``; a run that opens a new chain has none. An interval that is missing
    lets nothing continue.
    """
    key, order = ["schedule_id"], ["start", "run_id"]
    waits = policy.select("schedule_id", "retry_type", "retry_interval_seconds",
                          "submission_interval_seconds")
    rows = slice_hot_keys(runs, key, order, max_rows).join(waits, key, "left")
    rows = previous_values(rows, key, order,
                           {"_before_end": "end", "_before_outcome": "outcome"}, max_rows=None)
    kind = F.coalesce("retry_type", F.lit("OnFailure"))
    before = F.col("_before_outcome")

    def soon(interval: str) -> Column:
        return F.col("start") <= F.col("_before_end") + seconds(F.col(interval))

    retried = ((before == "failed") & kind.isin("OnFailure", "Always")) | (
        (before == "successful") & (kind == "Always"))
    resubmitted = (before == "submission_failed") & kind.isin("OnFailure", "Always")
    rows = rows.withColumn("continues", F.when(
        resubmitted & soon("submission_interval_seconds"), F.lit("submission")).when(
        retried & soon("retry_interval_seconds"), F.lit("run")))
    rows = rows.withColumn("_opens", F.when(F.col("continues").isNotNull(), 0).otherwise(1))
    rows = rows.drop("_before_end", "_before_outcome", "retry_type", "retry_interval_seconds",
                     "submission_interval_seconds")
    return (running(rows, key, order, "_opens", "sum", "chain", max_rows=None)
            .drop("_opens", SLICE))


def retry_chains(runs: DataFrame, policy: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per retry chain; ``exceeded`` if it holds more retries than the schedule allows.

    Runs and submissions have limits of their own, none allowed by default. Under ``Always`` runs
    are repeated without end, so only submissions can exceed theirs.
    """
    def continued(how: str) -> Column:
        return F.count_if(F.coalesce(F.col("continues") == how, F.lit(False)))

    chains = (number_chains(runs, policy, max_rows)
              .groupBy("schedule_id", "chain")
              .agg(F.count(F.lit(1)).alias("runs"),
                   F.min("start").alias("first_start"),
                   F.max("end").alias("last_end"),
                   F.max_by("outcome", F.struct("start", "run_id")).alias("last_outcome"),
                   continued("run").alias("retries"),
                   continued("submission").alias("submission_retries")))
    allowed = policy.select(
        "schedule_id", F.col("max_retries").alias("_runs"),
        F.col("max_submission_retries").alias("_submissions"),
        F.coalesce(F.col("retry_type") == "Always", F.lit(False)).alias("_always"))
    none = F.lit(0)
    too_many = ((F.col("retries") > F.coalesce("_runs", none))
                & ~F.coalesce("_always", F.lit(False))) | (
        F.col("submission_retries") > F.coalesce("_submissions", none))
    return (chains.join(allowed, "schedule_id", "left").withColumn("exceeded", too_many)
            .drop("_runs", "_submissions", "_always"))
