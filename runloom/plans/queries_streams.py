"""Registered queries that run as streams over all files there are, and return their result table.

Append mode never shows windows that are still open at the end, so the SQL leaves those out too: a
window is closed once it ends at or before the final watermark, the latest time less the allowed
delay, in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import logs as L
from runloom.operators import status as A
from runloom.plans import queries_records as Q
from runloom.plans import stand_ins as S
from runloom.plans.queries_reports import REPORT_SQL, rounded
from runloom.plans.registry import query, stream, table
from runloom.session import scratch_dir, stream_session
from runloom.sources import sinks
from runloom.streaming import ops as O
from runloom.streaming import stateful, timers
from runloom.streaming.reports import refresh_report


def watermark_sql(minutes: int) -> str:
    return f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {minutes} MINUTE FROM events)"


def events_in_time(spark, d):
    """Events with a session-independent event time."""
    return stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def collect_append(spark, out, name):
    path = scratch_dir(spark, name)
    return O.run_to_table(out, f"{path}/data", f"{path}/checkpoint")


def wall_clock(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("weekday_report_stream", REPORT_SQL)
def weekday_report_stream(spark, d):
    spark = stream_session(spark)
    trips = stream(spark, d, "lineitem").selectExpr(
        *[f"{source} AS {name}" for name, source in S.TRIP_COLUMNS.items()])
    path = scratch_dir(spark, "weekday_stream")
    refresh_report(trips, f"{path}/report", f"{path}/checkpoint", every=None).awaitTermination()
    return rounded(sinks.read_published(spark, f"{path}/report"))


@query("metric_stream", f"""
SELECT * FROM ({Q.GAUGES_SQL}) WHERE bucket_end <= {watermark_sql(10)}""")
def metric_stream(spark, d):
    spark = stream_session(spark)
    out = O.stream_metrics(S.as_metric_samples(stream(spark, d, "events")))
    rolled = collect_append(spark, out, "metric_stream")
    return wall_clock(rolled.withColumn("avg_value", F.round("avg_value", 6)),
                      "bucket_start", "bucket_end")


@query("latest_phase_stream", f"""
SELECT namespace, app, coalesce(state, 'Unknown') AS phase, ts AS since
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, app ORDER BY ts DESC, event_id DESC) AS n
      FROM ({S.STATUS_SQL})) WHERE n = 1""")
def latest_phase_stream(spark, d):
    spark = stream_session(spark)
    path = scratch_dir(spark, "phase_stream")
    status = S.as_status(stream(spark, d, "events"))
    O.stream_latest_phase(status, f"{path}/changes", f"{path}/checkpoint", A.APP, every=None,
                          state=F.col("application_state.state")).awaitTermination()
    return O.read_latest_phase(spark, f"{path}/changes", A.APP)


@query("log_stream", f"""
SELECT event_id, level, message FROM ({S.LOGS_SQL})
WHERE level IN ('INFO', 'WARN', 'ERROR', 'FATAL')
  AND NOT contains(message, 'Thrift error occurred during processing of message')""")
def log_stream(spark, d):
    """Text lines parsed and filtered on the way; only the root threshold can apply to them."""
    spark = stream_session(spark)
    lines = S.logs_of(stream(spark, d, "events")).select("event_id", "line")
    kept = L.drop_messages(L.filter_by_threshold(L.parse_logs(lines), [], "INFO", "logger"))
    return collect_append(spark, kept.select("event_id", "level", "message"), "log_stream")


@query("stream_tumbling", f"""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {watermark_sql(10)}""")
def stream_tumbling(spark, d):
    spark = stream_session(spark)
    out = (events_in_time(spark, d).withWatermark("ts", "10 minutes")
           .groupBy(F.window("ts", "1 hour"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
           .select(F.col("window.start").alias("window_start"), "event_type", "n", "total"))
    return wall_clock(collect_append(spark, out, "tumbling"), "window_start").withColumn(
        "total", F.round("total", 4))


@query("stream_sliding", f"""
SELECT window_start, count(*) AS n, round(max(value), 4) AS highest
FROM (SELECT value, unnest([date_trunc('hour', ts),
                            date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM events)
GROUP BY 1 HAVING window_start + INTERVAL 2 HOUR <= {watermark_sql(10)}""")
def stream_sliding(spark, d):
    spark = stream_session(spark)
    out = (events_in_time(spark, d).withWatermark("ts", "10 minutes")
           .groupBy(F.window("ts", "2 hours", "1 hour"))
           .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))
           .select(F.col("window.start").alias("window_start"), "n", "highest"))
    return wall_clock(collect_append(spark, out, "sliding"), "window_start").withColumn(
        "highest", F.round("highest", 4))


@query("stream_session", f"""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 4 HOUR AS session_end, count(*) AS n
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                 ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                           <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 4 HOUR <= {watermark_sql(10)}""")
def stream_session_windows(spark, d):
    spark = stream_session(spark)
    # Sessions are merged inside each task first, so a busy user is few rows by the shuffle.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = (events_in_time(spark, d).withWatermark("ts", "10 minutes")
           .groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id")
           .agg(F.count(F.lit(1)).alias("n"))
           .select("user_id", F.col("w.start").alias("session_start"),
                   F.col("w.end").alias("session_end"), "n"))
    return wall_clock(collect_append(spark, out, "sessions"), "session_start", "session_end")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event arrives twice; each is let through once."""
    spark = stream_session(spark)
    events = events_in_time(spark, d)
    out = (events.union(events).withWatermark("ts", "10 minutes")
           .dropDuplicatesWithinWatermark(["event_id"])
           .select("event_id", "user_id", "event_type"))
    return collect_append(spark, out, "dedup")


@query("stream_join", """
SELECT c_mktsegment, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""")
def stream_join(spark, d):
    """Stream with static table. Complete mode: the state is one row per segment and type."""
    spark = stream_session(spark)
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    events = stream(spark, d, "events").select("user_id", "event_type", "value")
    out = (events.join(customers, F.col("user_id") == F.col("c_custkey"))
           .groupBy("c_mktsegment", "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))
    path = scratch_dir(spark, "stream_static")
    joined = O.run_complete_to_table(out, f"{path}/data", f"{path}/checkpoint")
    return joined.withColumn("total", F.round("total", 4))


@query("stream_stream_join", """
SELECT event_id AS run_id, ts AS started, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS ended
FROM events""")
def stream_stream_join(spark, d):
    """Starts and ends of runs as two streams, joined by run within ten minutes; state expires."""
    spark = stream_session(spark)
    events = events_in_time(spark, d)
    starts = events.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started"))
    ends = events.select(F.col("event_id").alias("end_id"),
                         (F.col("ts") + S.seconds(F.floor("value"))).alias("ended"))
    out = starts.withWatermark("started", "10 minutes").join(
        ends.withWatermark("ended", "10 minutes"),
        F.expr("run_id = end_id AND ended >= started AND ended <= started + INTERVAL 10 MINUTES"))
    joined = collect_append(spark, out.select("run_id", "started", "ended"), "stream_stream")
    return wall_clock(joined, "started", "ended")


@query("stream_state", """
SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest
FROM events GROUP BY 1""")
def stream_state(spark, d):
    """State of our own per user, kept across micro-batches."""
    spark = stream_session(spark)
    path = scratch_dir(spark, "stream_state")
    tracked = stateful.track_activity(stream(spark, d, "events"), "user_id", "value")
    O.upsert_batches(tracked, f"{path}/changes", f"{path}/checkpoint", ["key"],
                     every=None).awaitTermination()
    merged = stateful.read_activity(O.read_changes(spark, f"{path}/changes"))
    return merged.withColumn("total", F.round("total", 4))


@query("expired_apps_stream", f"""
SELECT event_id, namespace, app, ttl_seconds, ended + to_seconds(ttl_seconds) AS expired_at
FROM ({S.STATUS_SQL}) WHERE ended + to_seconds(ttl_seconds) <= {watermark_sql(10)}""")
def expired_apps_stream(spark, d):
    """A record comes out when its time-to-live passes: event-time timers, not a later look."""
    spark = stream_session(spark)
    out = timers.stream_expired_apps(S.as_status(stream(spark, d, "events")))
    return wall_clock(collect_append(spark, out, "expired_apps"), "expired_at")


@query("missed_slots_stream", f"""
WITH slots AS (
    SELECT schedule_id, every_seconds, unnest(range(0, CAST(ceil(2592000 / every_seconds) AS BIGINT)))
           AS slot
    FROM ({S.SCHEDULES_SQL}) WHERE NOT suspend AND every_seconds > 0)
SELECT schedule_id, slot, TIMESTAMP '{Q.FROM_TO[0]}' + to_seconds(slot * every_seconds) AS slot_start
FROM slots s
WHERE TIMESTAMP '{Q.FROM_TO[0]}' + to_seconds((slot + 1) * every_seconds) <= {watermark_sql(10)}
  AND NOT EXISTS (
    SELECT 1 FROM ({S.RUNS_SQL}) r WHERE r.schedule_id = s.schedule_id
      AND r.start_ts >= TIMESTAMP '{Q.FROM_TO[0]}' + to_seconds(slot * every_seconds)
      AND r.start_ts < TIMESTAMP '{Q.FROM_TO[0]}' + to_seconds((slot + 1) * every_seconds)
      AND r.start_ts < TIMESTAMP '{Q.FROM_TO[1]}')""")
def missed_slots_stream(spark, d):
    """Slots that pass without a run, each when it has passed; schedules are the first state."""
    spark = stream_session(spark)
    out = timers.stream_missed_slots(S.schedules(spark, d), S.as_runs(stream(spark, d, "events")),
                                     *Q.FROM_TO)
    return collect_append(spark, out, "missed_slots")


@query("stream_first_seen",
       "SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS value FROM events")
def stream_first_seen(spark, d):
    """State that expires by itself: the users of each event type, once within a week of clock time."""
    spark = stream_session(spark)
    out = timers.first_seen(stream(spark, d, "events"), "event_type", "user_id", 7 * 86400)
    path = scratch_dir(spark, "first_seen")
    return O.run_once_to_table(out, f"{path}/data", f"{path}/checkpoint")
