"""Application status records: latest state, owners, parents, runtimes, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.naming import owner_class, repair_name
from runloom.functions.times import packed_order, seconds

# Fixed value: the label that names the job or session an application belongs to.
INSTANCE_LABEL = "app.kubernetes.io/instance"

# Executor states an application reports.
EXECUTOR_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "UNKNOWN"]

APP = ["namespace", "app"]

# Counts of one number, and the bits of each.
PACKED, PACKED_BITS = 3, 20


def latest_status(status: DataFrame, keys: Sequence[str] = APP, ts: str = "ts",
                  tiebreak: str = "event_id") -> DataFrame:
    """The newest record of each key, all columns.

    A maximum over records, so each task sends on one record per key, however hot a key is.
    """
    rest = [c for c in status.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, tiebreak)).alias("_newest")
    return (status.groupBy(*keys).agg(newest)
            .select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in rest]))


def latest_phase(events: DataFrame, key: Sequence[str], ts: str = "ts",
                 tiebreak: str = "event_id", state: str | Column = "state") -> DataFrame:
    """The newest phase of each key; ``Unknown`` if its newest record has no state."""
    state = F.col(state) if isinstance(state, str) else state
    record = F.struct(state.alias("phase"), F.col(ts).alias("since"))
    return (events.groupBy(*key)
            .agg(F.max_by(record, F.struct(ts, tiebreak)).alias("_newest"))
            .select(*key, F.coalesce("_newest.phase", F.lit("Unknown")).alias("phase"),
                    F.col("_newest.since").alias("since")))


def instance(labels: Column) -> Column:
    return F.try_element_at(labels, F.lit(INSTANCE_LABEL))


def _with_parent_key(status: DataFrame) -> DataFrame:
    return status.withColumn("_parent", instance(F.col("labels")))


def attach_parent(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """Join each status to its job or session by namespace and instance label.

    ``jobs`` has ``namespace``, ``name`` and anything else worth attaching. Both sides shuffle on
    the key and AQE splits a hot job; a job table small enough is broadcast by the planner, which
    checks its size.
    """
    parents = jobs.withColumnRenamed("name", "parent")
    joined = _with_parent_key(status).withColumnRenamed("_parent", "parent")
    return joined.join(parents, ["namespace", "parent"])


def orphan_status(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """Statuses whose job or session does not exist, and those that name none."""
    known = jobs.select("namespace", F.col("name").alias("_parent")).distinct()
    return (_with_parent_key(status).join(known, ["namespace", "_parent"], "left_anti")
            .withColumn("reason", F.when(F.col("_parent").isNull(), F.lit("no instance label"))
                        .otherwise(F.lit("parent does not exist")))
            .drop("_parent"))


def app_runtime(status: DataFrame) -> DataFrame:
    """Attempts, and seconds from last submission to end, per application.

    The times are those of the newest record; an application that has not ended has no runtime.
    Times arrive as text; text that is not a time counts as missing.
    """
    begun = F.try_to_timestamp(F.col("last_submission_attempt_time"))
    ended = F.try_to_timestamp(F.col("termination_time"))
    runtime = F.unix_seconds(ended) - F.unix_seconds(begun)
    # Numbers by a number: a hash aggregate, and no sort of the input.
    return (status.withColumns({"_runtime": runtime, "_order": packed_order(status, "ts", "event_id")})
            .groupBy(*APP)
            .agg(F.max("execution_attempts").alias("execution_attempts"),
                 F.max("submission_attempts").alias("submission_attempts"),
                 F.max_by("_runtime", "_order").alias("runtime_seconds")))


def executor_state_counts(status: DataFrame,
                          states: Sequence[str] = EXECUTOR_STATES) -> DataFrame:
    """Executors by state in each application's newest record; ``other`` holds unlisted states.

    Counted inside each record, so the executors are never spread out into rows. Three counts go into
    one number, which a hash aggregate can hold: a record may have up to a million executors.
    """
    values = F.map_values("executor_state")
    is_state = {name.lower(): (lambda s, name=name: s == name) for name in states}
    is_state["other"] = lambda s: ~s.isin(list(states))
    names = list(is_state)
    groups = [names[i:i + PACKED] for i in range(0, len(names), PACKED)]

    def packed(group: list[str]) -> Column:
        """The counts of some states, each in its own bits."""
        def add(total: Column, state: Column) -> Column:
            for i, name in enumerate(group):
                unit = F.lit(1 << PACKED_BITS * i).cast("long")
                total = total + F.when(is_state[name](state), unit).otherwise(F.lit(0).cast("long"))
            return total

        # A missing map has no executors in any state.
        return F.coalesce(F.aggregate(values, F.lit(0).cast("long"), add), F.lit(0).cast("long"))

    rows = status.select(*APP, packed_order(status, "ts", "event_id").alias("_order"),
                         *[packed(group).alias(f"_counts{n}") for n, group in enumerate(groups)])
    newest = rows.groupBy(*APP).agg(*[F.max_by(f"_counts{n}", "_order").alias(f"_counts{n}")
                                      for n in range(len(groups))])
    mask = (1 << PACKED_BITS) - 1
    return newest.select(*APP, *[
        F.shiftright(f"_counts{n}", PACKED_BITS * i).bitwiseAND(F.lit(mask).cast("long")).alias(name)
        for n, group in enumerate(groups) for i, name in enumerate(group)])


def classify_owner(status: DataFrame) -> DataFrame:
    """Add ``owner_class``, and ``owner_error`` for records without any owner list."""
    return (status.withColumn("owner_class", owner_class(F.col("owners")))
            .withColumn("owner_error", F.col("owners").isNull()))


def name_collisions(names: DataFrame) -> DataFrame:
    """Repaired names that more than one name of a namespace ends up with."""
    return (names.select("namespace", "name").distinct()
            .groupBy("namespace", repair_name(F.col("name")).alias("repaired"))
            .agg(F.count("name").alias("names"), F.min("name").alias("first_name"),
                 F.max("name").alias("last_name"))
            .where("names > 1"))


def collated_collisions(names: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Names of a namespace that are one name under a collation (as given: without case and accents).

    ``name`` is the smallest of them, ``names`` how many there are, ``uses`` how many rows they have.
    """
    counted = names.groupBy("namespace", "name").agg(F.count(F.lit(1)).alias("uses"))
    return (counted.withColumn("_collated", F.collate("name", collation))
            .groupBy("namespace", "_collated")
            .agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("names"),
                 F.sum("uses").alias("uses"))
            .where("names > 1").drop("_collated"))


def expired_apps(status: DataFrame, as_of: str) -> DataFrame:
    """Records that ended more than their time-to-live before ``as_of`` (text, with or without zone).

    Without a time-to-live, or without an end, nothing expires.
    """
    ended = F.try_to_timestamp(F.col("termination_time"))
    limit = ended + seconds(F.col("ttl_seconds"))
    return status.where(limit < F.to_timestamp(F.lit(as_of))).withColumn("expired_at", limit)
