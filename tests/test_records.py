"""Edge rows of logs, metrics, statuses, schedules and runs."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from runloom import schemas
from runloom.functions import metric_rules as R
from runloom.functions.times import every_seconds
from runloom.operators import dependencies as D
from runloom.operators import logs as L
from runloom.operators import metrics as M
from runloom.operators import runs as U
from runloom.operators import status as A
from runloom.sources import files


def at(minute, day=1):
    return datetime.datetime(2024, 1, day) + datetime.timedelta(minutes=minute)


# --- metrics ---------------------------------------------------------------------------------

# line after the common start -> expected name, type, query, executor
SHAPES = [
    ("driver.com.x.StreamingMetrics.streaming.lastCompletedBatch_schedulingDelay><>Value",
     "spark_streaming_driver_lastcompletedbatch_schedulingdelay", "UNTYPED", None, None),
    ("driver.spark.streaming.q1.inputRate-total><>Value",
     "spark_structured_streaming_driver_inputrate_total", "UNTYPED", "q1", None),
    ("0.executor.threadpool.activeTasks><>Value",
     "spark_executor_threadpool_activetasks", "GAUGE", None, "0"),
    ("driver.DAGScheduler.stage.failedStages><>Value",
     "spark_driver_dagscheduler_stage_failedstages", "GAUGE", None, None),
    ("driver.DAGScheduler.messageProcessingTime><>Count",
     "spark_driver_dagscheduler_messageprocessingtime_count", "COUNTER", None, None),
    ("driver.HiveExternalCatalog.fileCacheHits><>Count",
     "spark_driver_hiveexternalcatalog_filecachehits_count", "COUNTER", None, None),
    ("driver.CodeGenerator.compilationTime><>Count",
     "spark_driver_codegenerator_compilationtime_count", "COUNTER", None, None),
    ("driver.LiveListenerBus.numEventsPosted><>Count",
     "spark_driver_livelistenerbus_numeventsposted_count", "COUNTER", None, None),
    ("driver.LiveListenerBus.queue.shared.size><>Value",
     "spark_driver_livelistenerbus_queue_shared_size", "GAUGE", None, None),
    ("1.executor.bytesRead><>Count", "spark_executor_bytesread_count", "COUNTER", None, "1"),
    ("1.jvm.heap.used><>Value", "spark_executor_jvm_heap_used", "GAUGE", None, "1"),
    ("1.HiveExternalCatalog.fileCacheHits><>Count",
     "spark_executor_hiveexternalcatalog_filecachehits_count", "COUNTER", None, "1"),
    ("1.CodeGenerator.sourceCodeSize><>Count",
     "spark_executor_codegenerator_sourcecodesize_count", "COUNTER", None, "1"),
]


def samples(spark, lines):
    return spark.createDataFrame([(i, at(i), line, float(i)) for i, line in enumerate(lines)],
                                 schemas.METRIC_SAMPLE)


def test_one_line_per_rule(spark):
    got = M.normalize_metrics(samples(spark, [f"metrics<name=ns.app.{s[0]}" for s in SHAPES]))
    for row, shape in zip(sorted(got.collect()), SHAPES, strict=True):
        assert (row["metric"], row["type"], row["query_name"], row["executor_id"]) == shape[1:]
        assert (row["app_namespace"], row["app_id"]) == ("ns", "app")


def test_unmatched_dotted_and_short_lines(spark):
    lines = ["metrics<name=ns.app.other.thing><>Mean",
             "metrics<name=a.b.app.driver.CodeGenerator.compilationTime><>Count",
             "metrics<name=default/spark-pi.driver.DAGScheduler.stage.failedStages><>Value",
             "", None, "noise metrics<name=n.a.driver.jvm.heap><>Value: 3"]
    got = {r["sample_id"]: r for r in M.normalize_metrics(samples(spark, lines)).collect()}
    assert sorted(got) == [1, 5]
    assert (got[1]["app_namespace"], got[1]["app_id"]) == ("a.b", "app")
    assert got[5]["metric"] == "spark_driver_jvm_heap"
    kept = M.normalize_metrics(samples(spark, lines), keep_unmatched=True).collect()
    assert len(kept) == len(lines) and sum(r["metric"] is None for r in kept) == 4
    upper = M.normalize_metrics(samples(spark, lines), lowercase=False).where("sample_id = 1")
    assert upper.first()["metric"] == "spark_driver_CodeGenerator_compilationTime_count"


def test_first_rule_wins_and_empty_label_is_absent(spark):
    lines = ["metrics<name=n.a.driver.jvm.executor.x><>Value", "metrics<name=n.a..executor.x><>Count"]
    got = sorted(M.label_map(M.normalize_metrics(samples(spark, lines))).collect())
    assert got[0]["metric"] == "spark_executor_x"
    assert got[0]["labels"] == {"app_namespace": "n.a", "app_id": "driver", "executor_id": "jvm"}
    assert got[1]["metric"] == "spark_executor_x_count" and "executor_id" not in got[1]["labels"]


@pytest.mark.parametrize("rule", R.DEFAULT_RULES, ids=lambda r: r.name)
def test_literals_are_in_every_match(rule):
    assert all(text.replace(".", r"\.") in rule.pattern for text in rule.literals)
    assert max(int(n) for n in re.findall(r"\$(\d)", rule.name)) <= re.compile(rule.pattern).groups


def series(spark, points):
    return spark.createDataFrame(
        [(i, at(minute), "m", kind, "ns", "app", None, executor, value)
         for i, (minute, kind, executor, value) in enumerate(points)],
        "sample_id long, ts timestamp, metric string, type string, app_namespace string, "
        "app_id string, query_name string, executor_id string, value double")


def test_counter_delta_with_reset_across_slices(spark):
    points = [(0, "COUNTER", "1", 5.0), (30, "COUNTER", "1", 9.0), (200, "COUNTER", "1", 2.0),
              (201, "COUNTER", "1", 2.0), (201, "COUNTER", None, 4.0), (300, "GAUGE", "1", 9.0)]
    for most in (1, 2, 10 ** 6):
        got = {r["sample_id"]: (r["delta"], r["reset"])
               for r in M.counter_delta(series(spark, points), most).collect()}
        assert got == {0: (None, False), 1: (4.0, False), 2: (2.0, True), 3: (0.0, False),
                       4: (None, False)}


def test_gauge_rollup_takes_the_last_sample_of_equal_times(spark):
    points = [(1, "GAUGE", "1", 5.0), (2, "GAUGE", "1", 1.0), (2, "GAUGE", "1", 3.0),
              (60, "GAUGE", "1", 8.0), (60, "COUNTER", "1", 99.0)]
    first, second = sorted(M.gauge_rollup(series(spark, points)).collect(),
                           key=lambda r: r["bucket_start"])
    assert (first["last_value"], first["min_value"], first["max_value"], first["avg_value"],
            first["samples"]) == (3.0, 1.0, 5.0, 3.0, 3)
    assert second["samples"] == 1 and second["bucket_start"] == at(60)


# --- logs ------------------------------------------------------------------------------------

def test_parse_bad_date_and_plain_text(spark):
    lines = spark.createDataFrame(
        [(0, "24/01/02 03:04:05 INFO Main: hello: there"), (1, "24/13/45 03:04:05 WARN A: m"),
         (2, "  at java.lang.Thread"), (3, "24/01/02 03:04:05 INFO Main: "), (4, None)],
        "id int, line string")
    got = {r["id"]: r for r in L.parse_logs(lines).collect()}
    assert got[0]["ts"] == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert (got[0]["level"], got[0]["logger"], got[0]["message"]) == ("INFO", "Main", "hello: there")
    assert got[1]["ts"] is None and got[1]["level"] == "WARN"
    assert got[2]["level"] is None and got[2]["message"] == "  at java.lang.Thread"
    assert got[3]["message"] == "" and got[4]["message"] is None


def test_threshold_longest_name_and_dot_boundary(spark):
    logs = spark.createDataFrame([
        ("org.sparkproject.jetty.Server", "WARN"), ("org.sparkproject.jetty.Server", "INFO"),
        ("org.sparkproject.jetty.util.component.AbstractLifeCycle", "WARN"),
        ("org.sparkproject.jettyx", "INFO"), ("any.Thing", "DEBUG"), ("parquet", "WARN"),
        ("parquet", "ERROR"), ("any.Thing", "NONSENSE"), (None, "INFO")],
        "logger_full string, level string")
    kept = [tuple(r) for r in L.filter_by_threshold(logs).collect()]
    assert sorted(kept, key=str) == sorted(
        [("org.sparkproject.jetty.Server", "WARN"), ("org.sparkproject.jettyx", "INFO"),
         ("parquet", "ERROR"), (None, "INFO")], key=str)
    assert L.filter_by_threshold(logs, [], "DEBUG").where("level = 'DEBUG'").count() == 1


def test_drop_messages_keeps_missing_messages(spark):
    logs = spark.createDataFrame(
        [("x Thrift error occurred during processing of message y",), ("fine",), (None,)],
        "message string")
    assert sorted(str(r[0]) for r in L.drop_messages(logs).collect()) == ["None", "fine"]


@pytest.mark.parametrize("max_bytes", [64, 1 << 20])
def test_events_of_several_lines_over_many_splits(spark, tmp_path, max_bytes):
    """Tiny splits cut events, and even runs of continuation lines, apart."""
    one = ["lost stack line", "24/01/01 00:00:01 ERROR A: first", "  at x", "", "  at y"]
    one += ["24/01/01 00:00:02 INFO B: second"]
    one += [f"  frame {i:04d} of a very long trace" for i in range(40)]
    one += ["24/01/01 00:00:03 INFO C: third"]
    (tmp_path / "a.log").write_text("\n".join(one) + "\n")
    (tmp_path / "b.log").write_text("24/01/01 00:00:04 WARN D: other\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
    try:
        lines = files.read_lines(spark, str(tmp_path))
        numbered = L.number_lines(lines).where(F.col("file").endswith("a.log")).collect()
        events = L.assemble_log_events(lines).collect()
        parts = L.assemble_log_events(lines, max_lines=10).where("logger IS NULL OR logger != 'A'")
        assert parts.where("logger = 'B' AND level = 'INFO' AND ts IS NOT NULL").count() == 5
        parts = parts.where(F.col("file").endswith("a.log") & (F.col("event_line") == 6)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in sorted(numbered, key=lambda r: r["line_no"])] == one
    by_logger = {r["logger"]: r for r in events}
    assert set(by_logger) == {None, "A", "B", "C", "D"}
    assert by_logger[None]["message"] == "lost stack line" and by_logger[None]["ts"] is None
    assert by_logger["A"]["message"] == "first\n  at x\n\n  at y"
    assert by_logger["B"]["n_lines"] == 41
    assert by_logger["B"]["message"].split("\n") == ["second"] + one[6:46]
    assert by_logger["D"]["message"] == "other"
    parts.sort(key=lambda r: r["part"])
    assert [r["n_lines"] for r in parts] == [10, 10, 10, 10, 1]
    assert "\n".join(r["message"] for r in parts).split("\n") == ["second"] + one[6:46]


def test_an_event_of_any_length_is_one_row_with_its_head(spark, tmp_path):
    frames = "".join(f"  at frame {i}\n" for i in range(200_000))
    (tmp_path / "a.log").write_text(f"24/01/01 00:00:01 ERROR A: first\n{frames}"
                                    "24/01/01 00:00:02 DEBUG B: second\n")
    events = L.assemble_log_events(files.read_lines(spark, str(tmp_path)))
    [kept] = events.where("level = 'ERROR'").collect()
    assert kept["n_lines"] == 200_001 and kept["part"] == 0
    assert kept["message"] == "first\n" + frames[:-1]


# --- status ----------------------------------------------------------------------------------

def status(spark, **columns):
    """Rows of the status schema from lists of a few columns; the rest is NULL."""
    n = len(next(iter(columns.values())))
    base = {"event_id": list(range(n)), "ts": [at(0)] * n, "namespace": ["ns"] * n,
            "app": ["app"] * n}
    data = {**base, **columns}
    rows = [tuple(data[f.name][i] if f.name in data else None for f in schemas.STATUS)
            for i in range(n)]
    return spark.createDataFrame(rows, schemas.STATUS)


def test_latest_phase_missing_state_and_equal_times(spark):
    got = A.latest_phase(status(
        spark, app=["a", "a", "b", "b", "c"], ts=[at(1), at(1), at(1), at(0), at(0)],
        application_state=[("RUNNING", None), ("FAILED", "boom"), None, ("RUNNING", None),
                           (None, None)]), A.APP, state=F.col("application_state.state"))
    assert {r["app"]: r["phase"] for r in got.collect()} == {
        "a": "FAILED", "b": "Unknown", "c": "Unknown"}


def test_owner_precedence(spark):
    def owners(*kinds):
        return [(k, "x") for k in kinds]
    got = A.classify_owner(status(spark, owners=[
        owners("SparkScheduledJob", "SparkSession", "SparkJob"),
        owners("SparkScheduledJob", "SparkSession"), owners("Pod", "SparkScheduledJob"),
        owners("ScheduledSparkApplication"), [], None])).orderBy("event_id").collect()
    assert [r["owner_class"] for r in got] == [
        "SparkJob", "SparkSession", "SparkScheduledJob", "Other", "Other", None]
    assert [r["owner_error"] for r in got] == [False] * 5 + [True]


def test_parents_and_orphans(spark):
    key = A.INSTANCE_LABEL
    rows = status(spark, labels=[{key: "job"}, {key: "gone"}, {"x": "y"}, None, {key: "job"}],
                  namespace=["ns", "ns", "ns", "ns", "other"])
    jobs = spark.createDataFrame([("ns", "job", "SparkJob")], "namespace string, name string, kind string")
    joined = A.attach_parent(rows, jobs).collect()
    assert [(r["event_id"], r["parent"], r["kind"]) for r in joined] == [(0, "job", "SparkJob")]
    orphans = {r["event_id"]: r["reason"] for r in A.orphan_status(rows, jobs).collect()}
    assert orphans == {1: "parent does not exist", 2: "no instance label",
                       3: "no instance label", 4: "parent does not exist"}


def test_runtime_of_newest_record(spark):
    got = A.app_runtime(status(
        spark, app=["a", "a", "b", "c"], ts=[at(0), at(9), at(0), at(0)],
        last_submission_attempt_time=["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z",
                                      "2024-01-01T00:00:00Z", "never"],
        termination_time=["2024-01-01T00:10:00Z", "2024-01-01T01:00:30Z", None,
                          "2024-01-01T00:10:00Z"],
        execution_attempts=[3, 1, None, 1], submission_attempts=[1, 2, 1, None])).collect()
    assert {r["app"]: (r["execution_attempts"], r["submission_attempts"], r["runtime_seconds"])
            for r in got} == {"a": (3, 2, 30), "b": (None, 1, None), "c": (1, None, None)}


def test_executor_states_with_unlisted_and_missing(spark):
    got = A.executor_state_counts(status(
        spark, app=["a", "a", "b"], ts=[at(0), at(1), at(0)],
        executor_state=[{"e": "FAILED"}, {"1": "RUNNING", "2": "RUNNING", "3": "LOST"}, None]))
    assert {r["app"]: (r["running"], r["failed"], r["other"]) for r in got.collect()} == {
        "a": (2, 0, 1), "b": (0, 0, 0)}


def test_expired_is_strict_and_needs_end_and_ttl(spark):
    end = "2024-01-01T00:00:00Z"
    got = A.expired_apps(status(spark, termination_time=[end, end, end, None],
                                ttl_seconds=[3599, 3600, None, 1]), "2024-01-01T01:00:00Z")
    assert [r["event_id"] for r in got.collect()] == [0]


def test_name_collisions_per_namespace(spark):
    names = spark.createDataFrame([("a", "x.y"), ("a", "x-y"), ("a", "x.y"), ("b", "x.y"),
                                   ("a", "z.z"), ("a", "z.z")], "namespace string, name string")
    got = A.name_collisions(names).collect()
    assert [tuple(r) for r in got] == [("a", "x-y", 2, "x-y", "x.y")]


# --- schedules and runs ----------------------------------------------------------------------

def schedules(spark, rows):
    """Schedules from their first columns; the rest is NULL."""
    width = len(schemas.SCHEDULES)
    return spark.createDataFrame([(*row, *[None] * (width - len(row))) for row in rows], schemas.SCHEDULES)


def runs(spark, rows):
    return spark.createDataFrame(rows, schemas.RUNS)


def test_missed_slots(spark):
    plans = schedules(spark, [(1, 600, False, None, None, None, None, None),
                              (2, 600, True, None, None, None, None, None),
                              (3, None, None, None, None, None, None, None),
                              (4, 1800, None, None, None, None, None, None)])
    done = runs(spark, [(1, 1, at(0), at(1), "successful"), (1, 2, at(9), at(10), "failed"),
                        (1, 3, at(20), None, "failed"), (1, 4, at(30), at(31), "failed"),
                        (2, 5, at(0), at(1), "successful")])
    got = U.missed_slots(plans, done, "2024-01-01 00:00:00", "2024-01-01 00:30:00").collect()
    assert sorted((r["schedule_id"], r["slot"], r["slot_start"]) for r in got) == [
        (1, 1, at(10)), (4, 0, at(0))]
    assert U.missed_slots(plans, done, "2024-01-01 00:00:00", "2024-01-01 00:00:00").count() == 0


def test_overlaps(spark):
    plans = schedules(spark, [(1, 60, False, "Forbid", None, None, None, None),
                              (2, 60, False, None, None, None, None, None)])
    data = [(1, 1, at(0), at(100), "successful"), (1, 2, at(10), at(20), "successful"),
            (1, 3, at(99), at(120), "successful"), (1, 4, at(120), at(121), "successful"),
            (2, 5, at(0), None, None), (2, 6, at(1000, 3), at(1001, 3), "failed"),
            (3, 7, at(0), at(5), "failed"), (3, 8, at(0), at(5), "failed")]
    for most in (1, 2, 10 ** 6):
        got = U.overlapping_runs(runs(spark, data), plans, most).collect()
        assert {r["run_id"]: (r["policy"], r["finding"]) for r in got} == {
            2: ("Forbid", True), 3: ("Forbid", True), 6: ("Allow", False), 8: (None, False)}
    counts = U.overlap_counts(U.overlapping_runs(runs(spark, data), plans)).collect()
    assert {r["schedule_id"]: (r["overlaps"], r["findings"]) for r in counts} == {
        1: (2, 2), 2: (1, 0), 3: (1, 0)}


def test_retention_defaults_to_one(spark):
    plans = schedules(spark, [(1, 60, False, None, 2, None, None, None),
                              (2, 60, False, None, 0, 3, None, None)])
    data = [(s, 10 * s + i, at(i), at(i), "failed" if i % 2 else "successful")
            for s in (1, 2, 3) for i in range(6)] + [(1, 99, at(50), None, "running")]
    got = U.retained_runs(runs(spark, data), plans).collect()
    assert sorted(r["run_id"] for r in got) == [12, 14, 15, 21, 23, 25, 34, 35]


def test_retry_chains(spark):
    plans = schedules(spark, [
        (1, 60, False, None, None, None, 300, 1, None, None, None),
        (2, 60, False, None, None, None, None, None, "OnFailure", None, None),
        (3, 60, False, None, None, None, 300, 9, "Never", 300, 9),
        (4, 60, False, None, None, None, 300, 0, "Always", 300, 9),
        (5, 60, False, None, None, None, 60, 9, "OnFailure", 600, 1)])
    data = [(1, 1, at(0), at(1), "failed"), (1, 2, at(6), at(7), "failed"),
            (1, 3, at(8), at(9), "successful"), (1, 4, at(10), at(11), "failed"),
            (1, 5, at(17), at(18), "failed"), (2, 6, at(0), at(1), "failed"),
            (2, 7, at(1), at(2), "failed"),
            (3, 8, at(0), at(1), "failed"), (3, 9, at(1), at(2), "submission_failed"),
            (3, 10, at(2), at(3), "failed"),
            (4, 11, at(0), at(1), "successful"), (4, 12, at(2), at(3), "failed"),
            (4, 13, at(4), at(5), "successful"),
            (5, 14, at(0), at(1), "submission_failed"), (5, 15, at(9), at(10), "submission_failed"),
            (5, 16, at(15), at(16), "failed"), (5, 17, at(30), at(31), "successful")]
    for most in (1, 3, 10 ** 6):
        got = U.retry_chains(runs(spark, data), plans, most).collect()
        assert sorted((r["schedule_id"], r["chain"], r["runs"], r["retries"], r["exceeded"])
                      for r in got) == [(1, 1, 3, 2, True), (1, 2, 1, 0, False),
                                        (1, 3, 1, 0, False), (2, 1, 1, 0, False),
                                        (2, 2, 1, 0, False), (3, 1, 1, 0, False),
                                        (3, 2, 1, 0, False), (3, 3, 1, 0, False),
                                        (4, 1, 3, 2, False), (5, 1, 3, 0, True),
                                        (5, 2, 1, 0, False)]


def test_retry_chains_of_more_schedules_than_slices(spark):
    """All above the limit, and none above the share of the rows that a slice has."""
    first = spark.range(10_000).select(F.col("id").alias("schedule_id"), F.lit("failed").alias("outcome"))
    data = first.select("schedule_id", (F.col("schedule_id") * 2 + 1).alias("run_id"),
                        F.lit(at(5)).alias("start"), F.lit(at(6)).alias("end"), "outcome").union(
        first.select("schedule_id", F.col("schedule_id") * 2, F.lit(at(0)), F.lit(at(1)), "outcome"))
    plans = schedules(spark, [(n, 60, False, None, None, None, 300, 1, None, None, None) for n in (1, 2)])
    got = U.retry_chains(data, plans, 1).groupBy("schedule_id").agg(
        F.collect_list("runs").alias("runs")).collect()
    assert len(got) == 10_000
    assert all(sorted(r["runs"]) == ([2] if r["schedule_id"] in (1, 2) else [1, 1]) for r in got)


def test_every_seconds(spark):
    texts = ["@every 5m", "@every 1h30m", "@every 90s", "@hourly", "@daily", "@weekly",
             "*/5 * * * *", "@every", "@every 5x", "@every 0s", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(every_seconds(F.col("s"))).collect()] == [
        300, 5400, 90, 3600, 86400, 604800, None, None, None, None, None]


# --- dependencies ----------------------------------------------------------------------------

def test_dependencies_keep_duplicates_and_order(spark):
    deps = spark.createDataFrame(
        [("a", "env_set", 5, "jar", "m.jar"), ("a", "own", 3, "jar", "x.jar"),
         ("a", "catalog", 0, "jar", "i.jar"), ("a", "catalog", 0, "jar", "i.jar"),
         ("a", "own", 7, "jar", "i.jar"), ("b", "catalog", 0, "jar", "i.jar"),
         ("a", "own", 1, "package", "p"), ("a", "catalog", 1, "package", "q")],
        schemas.DEPENDENCIES)
    for most in (1, 2, 100):
        placed = D.dependency_order(deps, most).where("app = 'a'").orderBy("kind", "place").collect()
        assert [(r["kind"], r["place"], r["name"]) for r in placed] == [
            ("jar", 0, "x.jar"), ("jar", 1, "i.jar"), ("jar", 2, "i.jar"), ("jar", 3, "i.jar"),
            ("jar", 4, "m.jar"), ("package", 0, "p"), ("package", 1, "q")]
    usage = {r["name"]: r for r in D.dependency_usage(deps).collect()}
    assert (usage["i.jar"]["apps"], usage["i.jar"]["uses"], usage["i.jar"]["catalog_uses"]) == (2, 4, 3)


def test_places_of_the_stand_in_have_no_gaps(spark, sf_dir):
    from runloom.plans import stand_ins
    placed = D.dependency_order(stand_ins.dependencies(spark, sf_dir))
    order = F.when(F.col("source") == "own", 1).when(F.col("source") == "catalog", 2).otherwise(3)
    per_list = placed.groupBy("app", "kind").agg(
        F.sort_array(F.collect_list("place")).alias("places"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", order.alias("o")))),
                    lambda x: x["o"]).alias("sources"))
    wrong = per_list.where((F.col("places") != F.sequence(F.lit(0).cast("long"),
                                                          F.size("places").cast("long") - 1))
                           | (F.col("sources") != F.sort_array("sources")))
    assert per_list.count() > 0 and wrong.count() == 0
