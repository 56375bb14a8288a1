"""Operational records derived by formula, row by row, from the benchmark tables.

Each one comes twice: as a DataFrame, and as the SQL that derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.times import seconds
from runloom.operators.status import INSTANCE_LABEL
from runloom.plans.registry import table


def _pick(options: list[str], index) -> F.Column:
    return F.array(*[F.lit(o) for o in options])[index]


def _sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


# --- trips: lineitem under the trip table's column names -----------------------------------

TRIP_COLUMNS = {
    "VendorID": "l_suppkey",
    "tpep_pickup_datetime": "l_shipdate",
    "passenger_count": "CAST(l_linenumber AS BIGINT)",
    "trip_distance": "l_quantity",
    "total_amount": "l_extendedprice",
}


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{source} AS {name}" for name, source in TRIP_COLUMNS.items()])


TRIPS_SQL = ("SELECT " + ", ".join(f"{source} AS {name}" for name, source in TRIP_COLUMNS.items())
             + " FROM lineitem")

# All 18 columns, with NULLs, quotes, separators, blanks and empty texts; the same SQL in both engines.
FULL_TRIPS = {
    "VendorID": "CAST(nullif(l_suppkey, 3) AS BIGINT)",
    "tpep_pickup_datetime": "CASE WHEN l_orderkey % 13 <> 0 THEN l_shipdate END",
    "tpep_dropoff_datetime": "CASE WHEN l_orderkey % 17 <> 0 THEN l_shipdate END",
    "passenger_count": "CAST(nullif(l_linenumber, 2) AS BIGINT)",
    "trip_distance": "CASE WHEN l_linenumber <> 5 THEN l_quantity END",
    "RatecodeID": "CAST(l_partkey % 7 AS BIGINT)",
    "store_and_fwd_flag": "CASE l_partkey % 6 WHEN 0 THEN 'a, b' WHEN 1 THEN 'say \"x\"' WHEN 2 THEN '' "
                          "WHEN 3 THEN ' padded ' WHEN 4 THEN 'N; é' END",
    "dropoff_longitude": "-l_extendedprice",
    "dropoff_latitude": "CASE WHEN l_partkey % 9 <> 0 THEN l_discount END",
    "payment_type": "CAST(l_linenumber AS BIGINT)",
    "fare_amount": "l_extendedprice",
    "extra": "l_discount",
    "mta_tax": "l_tax",
    "tip_amount": "CASE WHEN l_returnflag = 'R' THEN l_quantity END",
    "tolls_amount": "CAST(0 AS DOUBLE)",
    "improvement_surcharge": "CASE WHEN l_partkey % 2 = 0 THEN l_tax END",
    "total_amount": "l_extendedprice",
    "congestion_surcharge": "nullif(l_quantity, 7)",
}


def full_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{source} AS {name}" for name, source in FULL_TRIPS.items()])


FULL_TRIPS_SQL = ("SELECT " + ", ".join(f"{source} AS {name}" for name, source in FULL_TRIPS.items())
                  + " FROM lineitem")

# --- metric samples: one exporter line per event --------------------------------------------

METRIC_TAILS = [
    "driver.com.x.StreamingMetrics.streaming.lastCompletedBatch_schedulingDelay><>Value",
    "driver.spark.streaming.q1.inputRate-total><>Value",
    "{e}.executor.threadpool.activeTasks><>Value",
    "driver.DAGScheduler.stage.failedStages><>Value",
    "driver.DAGScheduler.messageProcessingTime><>Count",
    "driver.HiveExternalCatalog.fileCacheHits><>Count",
    "driver.CodeGenerator.compilationTime><>Count",
    "driver.LiveListenerBus.numEventsPosted><>Count",
    "driver.LiveListenerBus.queue.shared.size><>Value",
    "{e}.executor.bytesRead><>Count",
    "{e}.jvm.heap.used><>Value",
    "{e}.HiveExternalCatalog.fileCacheHits><>Count",
    "{e}.CodeGenerator.sourceCodeSize><>Count",
    "other.thing><>Mean",
]


def as_metric_samples(events: DataFrame) -> DataFrame:
    tail = _pick(METRIC_TAILS, (F.col("event_id") % len(METRIC_TAILS)).cast("int"))
    executor = (F.col("event_id") % 3).cast("string")
    line = F.concat(F.lit("metrics<name=team."), F.lit("ns"), (F.col("user_id") % 5).cast("string"),
                    F.lit(".app-"), (F.col("user_id") % 40).cast("string"), F.lit("."),
                    F.replace(tail, F.lit("{e}"), executor))
    return events.select(F.col("event_id").alias("sample_id"), "ts", line.alias("line"), "value")


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_metric_samples(table(spark, sf_dir, "events"))


METRIC_SAMPLES_SQL = f"""
SELECT event_id AS sample_id, ts, value,
       'metrics<name=team.ns' || (user_id % 5) || '.app-' || (user_id % 40) || '.'
       || replace({_sql_list(METRIC_TAILS)}[event_id % {len(METRIC_TAILS)} + 1],
                  '{{e}}', CAST(event_id % 3 AS VARCHAR)) AS line
FROM events"""

# --- log lines: one per event ----------------------------------------------------------------

LOG_LEVELS = {"signup": "INFO", "purchase": "WARN", "error": "ERROR", "view": "DEBUG",
              "click": "FATAL"}
LOGGERS = [
    "org.apache.spark.scheduler.DAGScheduler",
    "org.apache.spark.repl.Main",
    "org.apache.parquet.hadoop.ParquetFileReader",
    "org.apache.parquetlike.Reader",
    "parquet.hadoop.Footer",
    "org.sparkproject.jetty.server.Server",
    "org.sparkproject.jetty.util.component.AbstractLifeCycle",
    "org.apache.hadoop.hive.metastore.RetryingHMSHandler",
    "org.apache.hadoop.hive.ql.exec.FunctionRegistry",
    "org.apache.spark.repl.SparkIMain$exprTyper",
    "org.apache.thrift.server.TThreadPoolServer",
]


def logs_of(events: DataFrame) -> DataFrame:
    """Parsed rows with full logger names, plus the text line the layout would print."""
    level = F.create_map(*[F.lit(x) for pair in LOG_LEVELS.items() for x in pair])[
        F.col("event_type")]
    logger = _pick(LOGGERS, (F.col("event_id") % len(LOGGERS)).cast("int"))
    message = F.when(F.col("value") < 10, F.concat(
        F.lit("Thrift error occurred during processing of message: "), F.col("props"))
    ).otherwise(F.concat(F.lit("took "), F.col("event_id").cast("string"), F.lit(" ms: "),
                         F.col("props")))
    rows = events.select(
        "event_id", "ts", level.alias("level"), logger.alias("logger_full"),
        message.alias("message"))
    short = F.element_at(F.split("logger_full", "\\."), -1)
    return rows.withColumn("line", F.concat(
        F.date_format("ts", "yy/MM/dd HH:mm:ss"), F.lit(" "), F.col("level"), F.lit(" "), short,
        F.lit(": "), F.col("message")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


LOGS_SQL = f"""
SELECT *, strftime(ts, '%y/%m/%d %H:%M:%S') || ' ' || level || ' '
          || string_split(logger_full, '.')[-1] || ': ' || message AS line
FROM (SELECT event_id, ts,
             CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LOG_LEVELS.items())}
             END AS level,
             {_sql_list(LOGGERS)}[event_id % {len(LOGGERS)} + 1] AS logger_full,
             CASE WHEN value < 10
                  THEN 'Thrift error occurred during processing of message: ' || props
                  ELSE 'took ' || event_id || ' ms: ' || props END AS message
      FROM events)"""

# --- application status: one record per event ------------------------------------------------

EXECUTOR_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "LOST"]


def as_status(events: DataFrame) -> DataFrame:
    kind, value, app = F.col("event_type"), F.col("value"), F.col("user_id")
    text = app.cast("string")
    zulu = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    end = F.col("ts") + seconds(F.round(value * 60, 2))

    def owner(*kinds: str):
        return F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit("o-"), text).alias("name"))
                         for k in kinds])

    owners = (F.when(kind == "click", owner("SparkJob"))
              .when(kind == "view", owner("SparkSession", "SparkJob"))
              .when(kind == "purchase", owner("Deployment", "SparkScheduledJob"))
              .when(kind == "signup", owner("ScheduledSparkApplication"))
              .when(value >= 50, owner("Deployment")))
    k = F.get_json_object("props", "$.k").cast("int")
    executors = F.when(k > 0, F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), k % 7 + 1), lambda i: F.concat(F.lit("exec-"), i)),
        F.transform(F.sequence(F.lit(1), k % 7 + 1),
                    lambda i: _pick(EXECUTOR_STATES, (i * k) % len(EXECUTOR_STATES)))))
    instance = F.when(value < 300, F.create_map(
        F.lit(INSTANCE_LABEL), F.concat(F.lit("job-"), text),
        F.lit("app.kubernetes.io/version"), F.lit("3.4.1"))).otherwise(
        F.create_map(F.lit("app.kubernetes.io/version"), F.lit("3.4.1")))
    return events.select(
        "event_id", "ts",
        F.concat(F.lit("ns"), (app % 5).cast("string")).alias("namespace"),
        F.concat(F.lit("app-"), text).alias("app"),
        F.date_format("ts", zulu).alias("last_submission_attempt_time"),
        F.when(kind.isin("error", "purchase"), F.date_format(end, zulu)).alias("termination_time"),
        F.when(value >= 5, F.struct(kind.alias("state"),
                                    F.when(kind == "error", F.col("props")).alias("error_message"))
               ).alias("application_state"),
        executors.alias("executor_state"),
        (F.col("event_id") % 4).cast("int").alias("execution_attempts"),
        (app % 3 + F.col("event_id") % 2).cast("int").alias("submission_attempts"),
        instance.alias("labels"),
        owners.alias("owners"),
        F.when(kind != "click", F.floor(value) * 3600).cast("long").alias("ttl_seconds"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_status(table(spark, sf_dir, "events"))


STATUS_SQL = f"""
SELECT event_id, ts, 'ns' || (user_id % 5) AS namespace, 'app-' || user_id AS app,
       date_trunc('second', ts) AS submitted,
       CASE WHEN event_type IN ('error', 'purchase') THEN date_trunc('second',
            ts + to_microseconds(CAST(round(value * 60, 2) * 1000000 AS BIGINT))) END AS ended,
       CASE WHEN value >= 5 THEN event_type END AS state,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 0
            THEN list_transform(
                range(1, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 + 2),
                lambda i: {_sql_list(EXECUTOR_STATES)}[
                    (i * CAST(json_extract_string(props, '$.k') AS INTEGER)) % 5 + 1])
       END AS executors,
       event_id % 4 AS execution_attempts, user_id % 3 + event_id % 2 AS submission_attempts,
       CASE WHEN value < 300 THEN 'job-' || user_id END AS instance,
       CASE event_type WHEN 'click' THEN ['SparkJob'] WHEN 'view' THEN ['SparkSession', 'SparkJob']
            WHEN 'purchase' THEN ['Deployment', 'SparkScheduledJob']
            WHEN 'signup' THEN ['ScheduledSparkApplication']
            ELSE CASE WHEN value >= 50 THEN ['Deployment'] END END AS owner_kinds,
       CASE WHEN event_type <> 'click' THEN CAST(floor(value) AS BIGINT) * 3600 END AS ttl_seconds
FROM events"""


# --- jobs and schedules: one per supplier ----------------------------------------------------

def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    place = (key + F.when(F.col("s_nationkey") == 3, 1).otherwise(0)) % 5
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ns"), place.cast("string")).alias("namespace"),
        F.concat(F.lit("job-"), key.cast("string")).alias("name"),
        F.when(key % 2 == 0, F.lit("SparkJob")).otherwise(F.lit("SparkSession")).alias("kind"))


JOBS_SQL = """
SELECT 'ns' || ((s_suppkey + CASE WHEN s_nationkey = 3 THEN 1 ELSE 0 END) % 5) AS namespace,
       'job-' || s_suppkey AS name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'SparkJob' ELSE 'SparkSession' END AS kind
FROM supplier"""

POLICIES = ["Allow", "Forbid", "Replace"]
RETRY_TYPES = ["Never", "Always", "OnFailure"]


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("schedule_id"),
        (F.lit(3600) * (1 + key % 24)).alias("every_seconds"),
        (nation == 0).alias("suspend"),
        _pick(POLICIES, (key % 3).cast("int")).alias("concurrency_policy"),
        F.when(nation % 4 != 0, nation % 5).cast("int").alias("successful_limit"),
        F.when(nation % 3 != 0, nation % 7).cast("int").alias("failed_limit"),
        (F.lit(3600) * (key % 12)).alias("retry_interval_seconds"),
        (key % 2).cast("int").alias("max_retries"),
        F.when(key % 5 != 0, _pick(RETRY_TYPES, (key % 3).cast("int"))).alias("retry_type"),
        (F.lit(1800) * (key % 7)).alias("submission_interval_seconds"),
        F.when(key % 6 != 0, key % 3).cast("int").alias("max_submission_retries"))


SCHEDULES_SQL = f"""
SELECT s_suppkey AS schedule_id, 3600 * (1 + s_suppkey % 24) AS every_seconds,
       s_nationkey = 0 AS suspend, {_sql_list(POLICIES)}[s_suppkey % 3 + 1] AS concurrency_policy,
       CASE WHEN s_nationkey % 4 <> 0 THEN s_nationkey % 5 END AS successful_limit,
       CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey % 7 END AS failed_limit,
       3600 * (s_suppkey % 12) AS retry_interval_seconds, s_suppkey % 2 AS max_retries,
       CASE WHEN s_suppkey % 5 <> 0 THEN {_sql_list(RETRY_TYPES)}[s_suppkey % 3 + 1] END AS retry_type,
       1800 * (s_suppkey % 7) AS submission_interval_seconds,
       CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 3 END AS max_submission_retries
FROM supplier"""


# --- runs: one per event ---------------------------------------------------------------------

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_runs(table(spark, sf_dir, "events"))


def as_runs(events: DataFrame) -> DataFrame:
    open_run = (F.col("event_type") == "signup") & (F.col("value") > 330)
    end = F.col("ts") + seconds(F.round(F.col("value") * 60, 2))
    return events.select(
        F.col("user_id").alias("schedule_id"), F.col("event_id").alias("run_id"),
        F.col("ts").alias("start"), F.when(~open_run, end).alias("end"),
        F.when(open_run, F.lit("running")).when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("successful")).alias("outcome"))


RUNS_SQL = """
SELECT user_id AS schedule_id, event_id AS run_id, ts AS start_ts,
       CASE WHEN NOT (event_type = 'signup' AND value > 330) THEN
            ts + to_microseconds(CAST(round(value * 60, 2) * 1000000 AS BIGINT)) END AS end_ts,
       CASE WHEN event_type = 'signup' AND value > 330 THEN 'running'
            WHEN event_type = 'error' THEN 'failed' ELSE 'successful' END AS outcome
FROM events"""


# --- dependencies: one per line item ---------------------------------------------------------

DEP_SOURCES = ["own", "catalog", "env_set"]
DEP_KINDS = ["jar", "file", "py_file", "package", "excluded_package", "repository"]


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("app-"), F.col("l_orderkey").cast("string")).alias("app"),
        _pick(DEP_SOURCES, F.col("l_linenumber") % 3).alias("source"),
        F.col("l_linenumber").alias("position"),
        _pick(DEP_KINDS, (F.col("l_partkey") % 12 % 6).cast("int")).alias("kind"),
        F.concat(F.lit("dep-"), F.col("l_partkey").cast("string")).alias("name"))


DEPENDENCIES_SQL = f"""
SELECT 'app-' || l_orderkey AS app, {_sql_list(DEP_SOURCES)}[l_linenumber % 3 + 1] AS source,
       l_linenumber AS position, {_sql_list(DEP_KINDS)}[l_partkey % 12 % 6 + 1] AS kind,
       'dep-' || l_partkey AS name
FROM lineitem"""


# --- owners and nested sets: one per part ----------------------------------------------------

# The same SQL in both engines, but for the sign of whole division.
_OWNERS = """
SELECT 'r-' || p_partkey AS name, {kinds} AS kind,
       CASE WHEN p_partkey % 50 = 1 THEN 'r-' || (p_partkey + 1)
            WHEN p_partkey % 50 = 2 THEN 'r-' || (p_partkey - 1)
            WHEN p_partkey % 40 = 5 THEN 'gone-' || p_partkey
            WHEN p_partkey >= 4 THEN 'r-' || (p_partkey {div} 3) END AS owner
FROM part"""
_KINDS = ("CASE p_partkey % 3 WHEN 0 THEN 'SparkJob' WHEN 1 THEN 'SparkSession' "
          "ELSE 'SparkScheduledJob' END")
OWNERS_SQL = _OWNERS.format(kinds=_KINDS, div="//")

_SETS = """
SELECT 'set-' || p_partkey AS source, 'set-' || (p_partkey {div} 2) AS target FROM part
WHERE p_partkey >= 2
UNION ALL
SELECT 'set-' || p_partkey, 'set-' || (p_partkey {div} 3) FROM part WHERE p_partkey >= 3
UNION ALL
SELECT 'set-' || p_partkey, 'set-' || (p_partkey * 2) FROM part WHERE p_partkey % 100 = 7"""
SETS_SQL = _SETS.format(div="//")


def _parts_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources and their owners: trees, cycles of two, and owners that are gone."""
    return _parts_view(spark, sf_dir, _OWNERS.format(kinds=_KINDS, div="DIV"))


def nested_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of dependencies that include other sets, with ways that meet again and cycles."""
    return _parts_view(spark, sf_dir, _SETS.format(div="DIV"))
