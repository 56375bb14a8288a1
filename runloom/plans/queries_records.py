"""Registered queries: logs, metrics, statuses, schedules and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions.logs import DEFAULT_THRESHOLDS, DROPPED_TEXT, HEAD
from runloom.functions.metric_rules import DEFAULT_RULES, LABELS
from runloom.operators import dependencies as D
from runloom.operators import logs as L
from runloom.operators import metrics as M
from runloom.operators import runs as U
from runloom.operators import status as A
from runloom.plans import stand_ins as S
from runloom.plans.registry import query, table
from runloom.session import scratch_dir
from runloom.sources import files, sinks

# --- metrics ---------------------------------------------------------------------------------


def _metrics_sql() -> str:
    """The rules as one CASE over patterns for each output column."""
    def case(branch) -> str:
        return ("CASE rule " + " ".join(f"WHEN {i} THEN {branch(rule)}"
                                        for i, rule in enumerate(DEFAULT_RULES, 1)) + " END")

    def group(rule, n: int) -> str:
        return f"nullif(regexp_extract(line, '{rule.pattern}', {n}), '')"

    def name(rule) -> str:
        parts = []
        for i, piece in enumerate(rule.name.split("$")):
            if i == 0:
                parts.append(f"'{piece}'")
            else:
                parts += [group(rule, int(piece[0])), f"'{piece[1:]}'"]
        return " || ".join(parts)

    def label(which: str):
        return lambda rule: (group(rule, rule.labels()[which]) if which in rule.labels()
                             else "CAST(NULL AS VARCHAR)")

    pick = "CASE " + " ".join(f"WHEN regexp_matches(line, '{r.pattern}') THEN {i}"
                              for i, r in enumerate(DEFAULT_RULES, 1)) + " END"
    return f"""
SELECT sample_id, ts, value,
       lower(regexp_replace({case(name)}, '[^a-zA-Z0-9:]+', '_', 'g')) AS metric,
       {case(lambda rule: f"'{rule.type}'")} AS type,
       {', '.join(f"{case(label(which))} AS {which}" for which in LABELS)}
FROM (SELECT *, {pick} AS rule FROM ({S.METRIC_SAMPLES_SQL})) WHERE rule IS NOT NULL"""


METRICS_SQL = _metrics_sql()
SERIES = "metric, type, app_namespace, app_id, query_name, executor_id"


@query("metric_normalize", METRICS_SQL)
def metric_normalize(spark, d):
    return M.normalize_metrics(S.metric_samples(spark, d))


@query("metric_labels", f"""
SELECT sample_id, metric, app_namespace AS ns, app_id AS app, query_name AS query,
       executor_id AS executor,
       CAST(2 + (query_name IS NOT NULL)::INT + (executor_id IS NOT NULL)::INT AS INTEGER) AS labels
FROM ({METRICS_SQL})""")
def metric_labels(spark, d):
    labelled = M.label_map(M.normalize_metrics(S.metric_samples(spark, d)))

    def of(name):
        return F.try_element_at("labels", F.lit(name))

    return labelled.select("sample_id", "metric", of("app_namespace").alias("ns"),
                           of("app_id").alias("app"), of("query_name").alias("query"),
                           of("executor_id").alias("executor"), F.size("labels").alias("labels"))


GAUGES_SQL = f"""
SELECT {SERIES}, date_trunc('hour', ts) AS bucket_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS bucket_end,
       last(value ORDER BY ts, sample_id) AS last_value, min(value) AS min_value,
       max(value) AS max_value, round(avg(value), 6) AS avg_value, count(value) AS samples
FROM ({METRICS_SQL}) WHERE type = 'GAUGE' GROUP BY ALL"""


@query("gauge_rollup", GAUGES_SQL)
def gauge_rollup(spark, d):
    rolled = M.gauge_rollup(M.normalize_metrics(S.metric_samples(spark, d)))
    return rolled.withColumn("avg_value", F.round("avg_value", 6))


@query("counter_delta", f"""
SELECT sample_id, ts, value, {SERIES},
       round(CASE WHEN value < before THEN value ELSE value - before END, 6) AS delta,
       coalesce(value < before, false) AS reset
FROM (SELECT *, lag(value) OVER (PARTITION BY {SERIES} ORDER BY ts, sample_id) AS before
      FROM ({METRICS_SQL}) WHERE type = 'COUNTER')""")
def counter_delta(spark, d):
    # Deltas read their input twice; a written table spares matching all lines again.
    path = scratch_dir(spark, "metrics")
    sinks.write_parquet(M.normalize_metrics(S.metric_samples(spark, d)), path)
    deltas = M.counter_delta(spark.read.parquet(path))
    return deltas.withColumn("delta", F.round("delta", 6))


# --- logs ------------------------------------------------------------------------------------

_RANK = "list_position(['ALL','TRACE','DEBUG','INFO','WARN','ERROR','FATAL','OFF'], {})"


@query("log_parse", f"""
SELECT event_id,
       strptime(regexp_extract(line, '{HEAD}', 1), '%y/%m/%d %H:%M:%S') AS ts,
       regexp_extract(line, '{HEAD}', 2) AS level, regexp_extract(line, '{HEAD}', 3) AS logger,
       regexp_replace(line, '{HEAD}', '') AS message
FROM ({S.LOGS_SQL})""")
def log_parse(spark, d):
    return L.parse_logs(S.logs(spark, d).select("event_id", "line"))


@query("log_threshold", f"""
WITH rules(prefix, min_level) AS (VALUES {', '.join(str(rule) for rule in DEFAULT_THRESHOLDS)}),
logs AS ({S.LOGS_SQL})
SELECT event_id, level, logger_full FROM logs l
WHERE {_RANK.format('level')} >= {_RANK.format('''coalesce(
    (SELECT arg_max(min_level, length(prefix)) FROM rules r
     WHERE l.logger_full = r.prefix OR starts_with(l.logger_full, r.prefix || '.')), 'INFO')''')}
""")
def log_threshold(spark, d):
    logs = S.logs(spark, d).select("event_id", "level", "logger_full")
    return L.filter_by_threshold(logs)


@query("log_drop", f"""
SELECT event_id, level, message FROM ({S.LOGS_SQL})
WHERE NOT contains(message, '{DROPPED_TEXT}')""")
def log_drop(spark, d):
    return L.drop_messages(S.logs(spark, d).select("event_id", "level", "message"))


@query("log_multiline", """
SELECT doc_id, TIMESTAMP '2024-01-01' + to_seconds(doc_id % 86400) AS ts, 'INFO' AS level,
       'Loader' AS logger, 'doc=' || doc_id || ' ' || text AS message,
       CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n_lines
FROM documents""")
def log_multiline(spark, d):
    """Whole document texts as the messages of a log, written as text files and put together."""
    path = scratch_dir(spark, "document_log")
    stamp = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz")
                          + S.seconds(F.col("doc_id") % 86400), "yy/MM/dd HH:mm:ss")
    entry = F.concat(stamp, F.lit(" INFO Loader: doc="), F.col("doc_id").cast("string"),
                     F.lit(" "), F.col("text"))
    table(spark, d, "documents").select(entry.alias("value")).write.text(path)
    events = L.assemble_log_events(files.read_lines(spark, path))
    doc = F.regexp_extract("message", r"^doc=(\d+) ", 1).cast("long")
    return events.select(doc.alias("doc_id"), "ts", "level", "logger", "message", "n_lines")


# --- application status ----------------------------------------------------------------------

@query("latest_phase", f"""
SELECT namespace, app, coalesce(state, 'Unknown') AS phase, ts AS since
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, app ORDER BY ts DESC, event_id DESC) AS n
      FROM ({S.STATUS_SQL})) WHERE n = 1""")
def latest_phase(spark, d):
    return A.latest_phase(S.status(spark, d), A.APP, state=F.col("application_state.state"))


@query("app_runtime", f"""
SELECT namespace, app, CAST(max(execution_attempts) AS INTEGER) AS execution_attempts,
       CAST(max(submission_attempts) AS INTEGER) AS submission_attempts,
       CAST(epoch(last(ended ORDER BY ts, event_id)) - epoch(last(submitted ORDER BY ts, event_id))
            AS BIGINT) AS runtime_seconds
FROM ({S.STATUS_SQL}) GROUP BY namespace, app""")
def app_runtime(spark, d):
    return A.app_runtime(S.status(spark, d))


def _count_state(name: str) -> str:
    return (f"CAST(coalesce(len(list_filter(executors, lambda s: s = '{name}')), 0) AS BIGINT) "
            f"AS {name.lower()}")


@query("executor_states", f"""
SELECT namespace, app, {', '.join(_count_state(s) for s in A.EXECUTOR_STATES)},
       CAST(coalesce(len(list_filter(executors, lambda s: s = 'LOST')), 0) AS BIGINT) AS other
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, app ORDER BY ts DESC, event_id DESC) AS n
      FROM ({S.STATUS_SQL})) WHERE n = 1""")
def executor_states(spark, d):
    return A.executor_state_counts(S.status(spark, d))


@query("status_parent_join", f"""
SELECT s.event_id, s.namespace, s.app, j.name AS parent, j.kind
FROM ({S.STATUS_SQL}) s JOIN ({S.JOBS_SQL}) j ON s.namespace = j.namespace AND s.instance = j.name
""")
def status_parent_join(spark, d):
    status = S.status(spark, d).select("event_id", "namespace", "app", "labels")
    return A.attach_parent(status, S.jobs(spark, d)).drop("labels")


@query("orphan_status", f"""
SELECT s.event_id, s.namespace, s.app,
       CASE WHEN s.instance IS NULL THEN 'no instance label' ELSE 'parent does not exist' END
       AS reason
FROM ({S.STATUS_SQL}) s WHERE NOT EXISTS (
    SELECT 1 FROM ({S.JOBS_SQL}) j WHERE s.namespace = j.namespace AND s.instance = j.name)""")
def orphan_status(spark, d):
    status = S.status(spark, d).select("event_id", "namespace", "app", "labels")
    return A.orphan_status(status, S.jobs(spark, d)).drop("labels")


@query("owner_class", f"""
SELECT event_id, CASE WHEN owner_kinds IS NULL THEN NULL
       WHEN list_contains(owner_kinds, 'SparkJob') THEN 'SparkJob'
       WHEN list_contains(owner_kinds, 'SparkSession') THEN 'SparkSession'
       WHEN list_contains(owner_kinds, 'SparkScheduledJob') THEN 'SparkScheduledJob'
       ELSE 'Other' END AS owner_class, owner_kinds IS NULL AS owner_error
FROM ({S.STATUS_SQL})""")
def owner_class(spark, d):
    return (A.classify_owner(S.status(spark, d).select("event_id", "owners"))
            .drop("owners"))


@query("name_collisions", """
SELECT namespace, replace(name, '.', '-') AS repaired, count(DISTINCT name) AS names,
       min(name) AS first_name, max(name) AS last_name
FROM (SELECT 'ns' || (user_id % 5) AS namespace,
             CASE WHEN event_type IN ('view', 'click') THEN 'team.app.' || user_id
                  WHEN event_type = 'error' AND value > 250 THEN 'team.app-' || user_id
                  ELSE 'team-app-' || user_id END AS name FROM events)
GROUP BY 1, 2 HAVING count(DISTINCT name) > 1""")
def name_collisions(spark, d):
    user = F.col("user_id").cast("string")
    prefix = (F.when(F.col("event_type").isin("view", "click"), "team.app.")
              .when((F.col("event_type") == "error") & (F.col("value") > 250), "team.app-")
              .otherwise("team-app-"))
    names = table(spark, d, "events").select(
        F.concat(F.lit("ns"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
        F.concat(prefix, user).alias("name"))
    return A.name_collisions(names)


@query("expired_apps", f"""
SELECT event_id, namespace, app, ttl_seconds, ended + to_seconds(ttl_seconds) AS expired_at
FROM ({S.STATUS_SQL})
WHERE ended + to_seconds(ttl_seconds) < TIMESTAMP '2024-01-20'""")
def expired_apps(spark, d):
    status = S.status(spark, d).select("event_id", "namespace", "app", "termination_time",
                                       "ttl_seconds")
    expired = A.expired_apps(status, "2024-01-20T00:00:00Z")
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                              F.col("expired_at").cast("timestamp_ntz"))
    return expired.withColumn("expired_at", wall).drop("termination_time")


# --- schedules and runs ----------------------------------------------------------------------

FROM_TO = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("missed_slots", f"""
WITH slots AS (
    SELECT schedule_id, every_seconds, unnest(range(0, CAST(ceil(2592000 / every_seconds) AS BIGINT)))
           AS slot
    FROM ({S.SCHEDULES_SQL}) WHERE NOT suspend AND every_seconds > 0)
SELECT schedule_id, slot, TIMESTAMP '{FROM_TO[0]}' + to_seconds(slot * every_seconds) AS slot_start
FROM slots s WHERE NOT EXISTS (
    SELECT 1 FROM ({S.RUNS_SQL}) r WHERE r.schedule_id = s.schedule_id
      AND r.start_ts >= TIMESTAMP '{FROM_TO[0]}' + to_seconds(slot * every_seconds)
      AND r.start_ts < TIMESTAMP '{FROM_TO[0]}' + to_seconds((slot + 1) * every_seconds)
      AND r.start_ts < TIMESTAMP '{FROM_TO[1]}')""")
def missed_slots(spark, d):
    return U.missed_slots(S.schedules(spark, d), S.runs(spark, d), *FROM_TO)


OVERLAPS_SQL = f"""
WITH runs AS ({S.RUNS_SQL})
SELECT a.schedule_id, a.run_id, a.start_ts AS start, a.end_ts AS "end", a.outcome,
       CASE WHEN s.schedule_id IS NOT NULL THEN s.concurrency_policy END AS policy,
       coalesce(s.concurrency_policy = 'Forbid', false) AS finding
FROM runs a LEFT JOIN ({S.SCHEDULES_SQL}) s ON a.schedule_id = s.schedule_id
WHERE EXISTS (SELECT 1 FROM runs b WHERE b.schedule_id = a.schedule_id
    AND (b.start_ts < a.start_ts OR (b.start_ts = a.start_ts AND b.run_id < a.run_id))
    AND coalesce(b.end_ts, TIMESTAMP '9999-12-31') > a.start_ts)"""


@query("overlapping_runs", OVERLAPS_SQL)
def overlapping_runs(spark, d):
    return U.overlapping_runs(S.runs(spark, d), S.schedules(spark, d))


@query("overlapping_runs_sliced", OVERLAPS_SQL)
def overlapping_runs_sliced(spark, d):
    """The same with keys cut into slices, as for a schedule with more runs than a task should get."""
    return U.overlapping_runs(S.runs(spark, d), S.schedules(spark, d), max_rows=8)


@query("overlap_counts", f"""
SELECT schedule_id, policy, count(*) AS overlaps, CAST(sum(finding::INT) AS BIGINT) AS findings
FROM ({OVERLAPS_SQL}) GROUP BY 1, 2""")
def overlap_counts(spark, d):
    return U.overlap_counts(U.overlapping_runs(S.runs(spark, d), S.schedules(spark, d)))


@query("retained_runs", f"""
SELECT schedule_id, run_id, start_ts AS start, end_ts AS "end", outcome
FROM (SELECT r.*, row_number() OVER (PARTITION BY r.schedule_id, outcome
                                     ORDER BY start_ts DESC, run_id DESC) AS n,
             coalesce(CASE outcome WHEN 'failed' THEN failed_limit ELSE successful_limit END, 1)
             AS keep
      FROM ({S.RUNS_SQL}) r LEFT JOIN ({S.SCHEDULES_SQL}) s ON r.schedule_id = s.schedule_id
      WHERE outcome IN ('failed', 'successful')) WHERE n <= keep""")
def retained_runs(spark, d):
    return U.retained_runs(S.runs(spark, d), S.schedules(spark, d))


RETRY_CHAINS_SQL = f"""
WITH runs AS (
    SELECT * REPLACE (CASE WHEN run_id % 11 = 0 AND outcome <> 'running' THEN 'submission_failed'
                           ELSE outcome END AS outcome) FROM ({S.RUNS_SQL})),
ordered AS (
    SELECT *, lag(end_ts) OVER w AS before_end, lag(outcome) OVER w AS before_outcome
    FROM runs WINDOW w AS (PARTITION BY schedule_id ORDER BY start_ts, run_id)),
flagged AS (
    SELECT o.*, s.max_retries, s.max_submission_retries, coalesce(retry_type, 'OnFailure') AS kind,
           CASE WHEN kind <> 'Never' AND before_outcome = 'submission_failed'
                     AND start_ts <= before_end + to_seconds(submission_interval_seconds)
                THEN 'submission'
                WHEN ((kind <> 'Never' AND before_outcome = 'failed')
                      OR (kind = 'Always' AND before_outcome = 'successful'))
                     AND start_ts <= before_end + to_seconds(retry_interval_seconds) THEN 'run' END
           AS continues
    FROM ordered o LEFT JOIN ({S.SCHEDULES_SQL}) s ON o.schedule_id = s.schedule_id),
numbered AS (
    SELECT *, CAST(sum(CASE WHEN continues IS NULL THEN 1 ELSE 0 END) OVER (
                       PARTITION BY schedule_id ORDER BY start_ts, run_id
                       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM flagged)
SELECT schedule_id, chain, count(*) AS runs, min(start_ts) AS first_start, max(end_ts) AS last_end,
       last(outcome ORDER BY start_ts, run_id) AS last_outcome,
       count(*) FILTER (continues = 'run') AS retries,
       count(*) FILTER (continues = 'submission') AS submission_retries,
       (count(*) FILTER (continues = 'run') > coalesce(max(max_retries), 0) AND max(kind) <> 'Always')
       OR count(*) FILTER (continues = 'submission') > coalesce(max(max_submission_retries), 0)
       AS exceeded
FROM numbered GROUP BY 1, 2"""


def _submitted_runs(spark, d):
    failed = (F.col("run_id") % 11 == 0) & (F.col("outcome") != "running")
    return S.runs(spark, d).withColumn(
        "outcome", F.when(failed, F.lit("submission_failed")).otherwise(F.col("outcome")))


@query("retry_chains", RETRY_CHAINS_SQL)
def retry_chains(spark, d):
    return U.retry_chains(_submitted_runs(spark, d), S.schedules(spark, d))


@query("retry_chains_sliced", RETRY_CHAINS_SQL)
def retry_chains_sliced(spark, d):
    """The same with keys cut into slices, as for a schedule with more runs than a task should get."""
    return U.retry_chains(_submitted_runs(spark, d), S.schedules(spark, d), max_rows=8)


# --- dependencies ----------------------------------------------------------------------------

@query("dependency_usage", f"""
SELECT kind, name, count(DISTINCT app) AS apps, count(*) AS uses,
       count(*) FILTER (source = 'own') AS own_uses,
       count(*) FILTER (source = 'catalog') AS catalog_uses,
       count(*) FILTER (source = 'env_set') AS env_set_uses
FROM ({S.DEPENDENCIES_SQL}) GROUP BY kind, name""")
def dependency_usage(spark, d):
    return D.dependency_usage(S.dependencies(spark, d))


DEPENDENCY_ORDER_SQL = f"""
SELECT app, source, position, kind, name, row_number() OVER (
         PARTITION BY app, kind
         ORDER BY CASE source WHEN 'own' THEN 1 WHEN 'catalog' THEN 2 ELSE 3 END, position, name) - 1
         AS place
FROM ({S.DEPENDENCIES_SQL})"""


@query("dependency_order", DEPENDENCY_ORDER_SQL)
def dependency_order(spark, d):
    return D.dependency_order(S.dependencies(spark, d))
