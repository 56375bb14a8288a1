"""Streams over several micro-batches: late rows, restarts, upserts."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from runloom import schemas
from runloom.operators import logs as L
from runloom.operators import metrics as M
from runloom.operators import runs as U
from runloom.operators import status as A
from runloom.plans import report as R
from runloom.session import stream_session
from runloom.sources import files, sinks
from runloom.streaming import ops, reports, stateful, timers


def at(minute):
    return datetime.datetime(2024, 1, 7) + datetime.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def session(spark):
    return stream_session(spark)


class Feed:
    """A folder that files are added to, read as a stream."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path / "in"), schema

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self, **options):
        return files.stream_files(self.spark, "parquet", self.path, self.schema, **options)


TRIP = "t timestamp, a double, d double, n long"
COLUMNS = dict(ts_col="t", amount_col="a", distance_col="d", count_col="n")


def test_report_follows_new_files_and_equals_batch(session, tmp_path):
    feed = Feed(session, tmp_path, TRIP).add([(at(0), 1.0, 2.0, 3), (None, 5.0, 5.0, 5)])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for extra in ([(at(1440), 7.0, 1.0, 1)], [(at(1), 3.0, 4.0, None)], []):
        if extra:
            feed.add(extra)
        reports.refresh_report(feed.stream(), out, checkpoint, every=None,
                               **COLUMNS).awaitTermination()
        batch = R.weekday_report(session.read.parquet(feed.path), **COLUMNS)
        assert sorted(map(str, sinks.read_published(session, out).collect())) == \
            sorted(map(str, batch.collect()))


def test_late_samples_are_dropped_after_the_watermark(session, tmp_path):
    line = "metrics<name=ns.app.1.jvm.heap.used><>Value"
    feed = Feed(session, tmp_path, schemas.METRIC_SAMPLE)
    data, checkpoint = str(tmp_path / "data"), str(tmp_path / "cp")

    def run():
        return ops.run_to_table(ops.stream_metrics(feed.stream(), width="10 minutes",
                                                   lateness="5 minutes"), data, checkpoint)

    feed.add([(1, at(1), line, 1.0), (2, at(2), line, 3.0), (3, at(31), line, 9.0)])
    assert [(r["last_value"], r["samples"]) for r in run().collect()] == [(3.0, 2)]
    feed.add([(4, at(3), line, 50.0), (5, at(27), line, 7.0), (6, at(60), line, 1.0)])
    got = {r["bucket_start"]: (r["last_value"], r["samples"]) for r in run().collect()}
    # Minute 3 came after its window was closed at watermark 26; minute 27 was still in time.
    assert got == {at(0): (3.0, 2), at(20): (7.0, 1), at(30): (9.0, 1)}


def test_latest_phase_over_batches_and_repeat(session, tmp_path):
    schema = "event_id long, ts timestamp, app string, state string"
    feed = Feed(session, tmp_path, schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        ops.stream_latest_phase(feed.stream(), out, checkpoint, ["app"],
                                every=None).awaitTermination()
        got = ops.read_latest_phase(session, out, ["app"])
        batch = A.latest_phase(session.read.parquet(feed.path), ["app"])
        assert sorted(got.collect()) == sorted(batch.collect())
        return {r["app"]: r["phase"] for r in got.collect()}

    feed.add([(1, at(0), "a", "SUBMITTED"), (2, at(5), "b", "RUNNING")])
    assert run() == {"a": "SUBMITTED", "b": "RUNNING"}
    feed.add([(3, at(6), "a", "RUNNING"), (4, at(1), "b", "SUBMITTED"), (5, at(6), "c", None)])
    assert run() == {"a": "RUNNING", "b": "RUNNING", "c": "Unknown"}
    assert run() == {"a": "RUNNING", "b": "RUNNING", "c": "Unknown"}


def test_own_state_is_kept_between_batches(session, tmp_path):
    feed = Feed(session, tmp_path, "k long, v double")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([(1, 2.0), (1, 5.0), (2, -1.0)], [(1, 3.0)]):
        feed.add(rows)
        ops.upsert_batches(stateful.track_activity(feed.stream(), "k", "v"), out, checkpoint, ["key"],
                           every=None).awaitTermination()
    got = stateful.read_activity(ops.read_changes(session, out)).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 10.0, 5.0), (2, 1, -1.0, -1.0)]
    feed.add([(7, None)])
    ops.upsert_batches(stateful.track_activity(feed.stream(), "k", "v"), out, checkpoint, ["key"],
                       every=None).awaitTermination()
    got = {r["key"]: tuple(r) for r in stateful.read_activity(ops.read_changes(session, out)).collect()}
    assert got[7] == (7, 1, None, None)


def phases_of(session, out):
    return {r["app"]: r["phase"] for r in ops.read_latest_phase(session, str(out), ["app"]).collect()}


def test_folders_of_batches_stay_few(session, tmp_path):
    feed = Feed(session, tmp_path, "event_id long, ts timestamp, app string, state string")
    out, checkpoint = tmp_path / "out", str(tmp_path / "cp")
    want = {}
    for n in range(13):
        feed.add([(n, at(n), f"app{n % 5}", f"S{n}")])
        want[f"app{n % 5}"] = f"S{n}"
        phases = A.latest_phase(feed.stream(), ["app"])
        ops.upsert_batches(phases, str(out), checkpoint, ["app"], every=None,
                           merge_every=3).awaitTermination()
        assert len([p for p in out.iterdir() if "=" in p.name]) <= 2 * 3 + 2
        assert phases_of(session, out) == want
    with pytest.raises(FileNotFoundError):
        ops.read_changes(session, str(tmp_path / "nothing"))


def test_readers_find_everything_in_the_middle_of_a_merge(session, tmp_path):
    out = tmp_path / "out"
    schema = "app string, phase string, since timestamp"

    def batch(n, rows):
        session.createDataFrame([(a, p, at(n)) for a, p in rows], schema).write.mode(
            "overwrite").parquet(f"{out}/batch={n}")

    for n in range(4):
        batch(n, [(f"app{n}", f"S{n}"), ("hot", f"S{n}")])
    want = {"app0": "S0", "app1": "S1", "app2": "S2", "app3": "S3", "hot": "S3"}
    early = ops.read_changes(session, str(out))  # a reader that has listed and not read yet
    ops.merge_batches(session, str(out), 3, ["app"])
    assert phases_of(session, out) == want
    assert early.count() == 8
    late = ops.read_changes(session, str(out))
    # A merge that fails while it writes leaves a folder that does not count.
    (out / "merged=4").mkdir()
    (out / "merged=4" / "part-0.parquet").write_bytes(b"half")
    assert phases_of(session, out) == want
    batch(4, [("hot", "S4")])
    want["hot"] = "S4"
    for _ in range(2):  # a merge may be repeated
        ops.merge_batches(session, str(out), 4, ["app"])
        assert phases_of(session, out) == want
    assert late.count() > 0 and {p.name for p in out.iterdir()} == {
        "merged=3", "merged=4", "batch=3", "batch=4"}


def test_log_filters_on_a_stream_equal_batch(session, tmp_path):
    feed = Feed(session, tmp_path, "logger_full string, level string, message string")
    feed.add([("parquet", "WARN", "x"), ("a.B", "INFO", "y"), ("a.B", "DEBUG", "z"),
              ("a.B", "ERROR", "Thrift error occurred during processing of message.")])

    def keep(df):
        return L.drop_messages(L.filter_by_threshold(df))

    got = ops.run_to_table(keep(feed.stream()), str(tmp_path / "d"), str(tmp_path / "c")).collect()
    assert got == keep(session.read.parquet(feed.path)).collect() and len(got) == 1


def test_stream_normalisation_equals_batch(session, tmp_path):
    feed = Feed(session, tmp_path, schemas.METRIC_SAMPLE).add(
        [(i, at(i), f"metrics<name=ns.app.{i}.jvm.heap.used><>Value", 1.0 * i) for i in range(5)])
    got = ops.run_to_table(M.normalize_metrics(feed.stream(max_files=1)), str(tmp_path / "d"),
                           str(tmp_path / "c"))
    want = M.normalize_metrics(session.read.parquet(feed.path))
    assert sorted(got.collect()) == sorted(want.collect())


def test_duplicates_in_later_batches(session, tmp_path):
    feed = Feed(session, tmp_path, "id long, ts timestamp")
    out = lambda: feed.stream().withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["id"])
    for rows, n in (([(1, at(0)), (1, at(1)), (2, at(2))], 2), ([(2, at(3)), (3, at(4))], 3)):
        feed.add(rows)
        table = ops.run_to_table(out(), str(tmp_path / "d"), str(tmp_path / "c"))
        assert table.select(F.count_distinct("id"), F.count("id")).first() == (n, n)


STATUS = ("namespace string, app string, event_id long, ts timestamp, termination_time string, "
          "ttl_seconds long")


def test_records_come_out_when_their_time_to_live_passes(session, tmp_path):
    def record(i, minute, ended, ttl, app="a"):
        end = None if ended is None else at(ended).strftime("%Y-%m-%dT%H:%M:%SZ")
        return ("ns", app, i, at(minute), end, ttl)

    feed = Feed(session, tmp_path, STATUS)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[record(1, 0, 1, 60), record(2, 1, 1, 600), record(3, 1, None, 60),
                record(4, 1, 1, None), record(5, 1, 1, 60)],
               [record(6, 5, 0, 60, "b")], [record(7, 12, 12, 3600)],
               [record(8, 100, 200, 60, None), record(8, 100, 30, 60, "c")], [record(9, 300, 300, 0)],
               [record(10, 400, None, 5)]]
    latest = None
    for rows in batches:  # every run starts anew from the checkpoint
        feed.add(rows)
        stream = timers.stream_expired_apps(feed.stream(), "1 minute")
        got = ops.run_to_table(stream, out, checkpoint)
        latest = max([r[3] for r in rows] + ([latest] if latest else []))
        now = latest - datetime.timedelta(minutes=1, microseconds=-1)
        batch = A.expired_apps(session.read.parquet(feed.path), now.strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
        columns = ["namespace", "app", "event_id", "ttl_seconds", "expired_at"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(
            map(str, batch.select(columns).collect()))
    assert got.count() == 8


def test_slots_come_out_when_they_pass_without_a_run(session, tmp_path):
    schedules = session.createDataFrame(
        [(1, 600, False), (2, 3600, False), (3, 60, True), (4, 0, False), (5, 7200, None)],
        "schedule_id long, every_seconds long, suspend boolean")
    feed = Feed(session, tmp_path, "schedule_id long, start timestamp")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    t0, t1 = "2024-01-07 00:00:00", "2024-01-07 07:30:00"
    latest = None
    for rows in ([(1, at(1)), (1, at(25)), (9, at(26))], [(2, at(100)), (1, at(95)), (1, at(96))],
                 [(1, at(180)), (5, at(185))], [(2, at(700))]):
        feed.add(rows)
        stream = timers.stream_missed_slots(schedules, feed.stream(), t0, t1, "0 seconds")
        got = ops.run_to_table(stream, out, checkpoint)
        latest = max([r[1] for r in rows] + ([latest] if latest else []))
        batch = U.missed_slots(schedules, session.read.parquet(feed.path), t0, t1).join(
            schedules.select("schedule_id", "every_seconds"), "schedule_id")
        over = F.expr("slot_start + make_dt_interval(0, 0, 0, every_seconds)") <= F.lit(latest)
        want = batch.where(over).select("schedule_id", "slot", "slot_start")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 40


def run_and_count_state(out, path, checkpoint):
    """The result as a table, and the most rows that the state has held."""
    query = (out.writeStream.outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).format("parquet").start(path))
    query.awaitTermination()
    most = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    return out.sparkSession.read.schema(out.schema).parquet(path), most


def test_state_of_waiting_records_is_by_share(session, tmp_path):
    """One application each, due within a second or within a year: some rows of state for all of them."""
    feed = Feed(session, tmp_path, STATUS)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    latest = None
    for n, minute in enumerate((0, 3, 2000, 90_000)):
        end = at(minute).strftime("%Y-%m-%dT%H:%M:%SZ")
        rows = [("ns", f"app{i}", 600 * n + i, at(minute), end, int(1.03 ** i)) for i in range(600)]
        feed.add(rows)
        latest = at(minute)
        stream = timers.stream_expired_apps(feed.stream(), "1 minute", 2)
        got, most = run_and_count_state(stream, out, checkpoint)
        assert most < 1000
        now = latest - datetime.timedelta(minutes=1, microseconds=-1)
        batch = A.expired_apps(session.read.parquet(feed.path), now.strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
        columns = ["namespace", "app", "event_id", "ttl_seconds", "expired_at"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(
            map(str, batch.select(columns).collect()))
    assert got.count() > 1000


def test_state_of_schedules_is_by_share(session, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "SCHEDULE_SHARES", 3, raising=False)
    schedules = session.range(500).selectExpr("id AS schedule_id", "60 * (1 + id % 50) AS every_seconds",
                                              "id % 9 = 0 AS suspend")
    feed = Feed(session, tmp_path, "schedule_id long, start timestamp")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    t0, t1 = "2024-01-07 00:00:00", "2024-01-07 07:30:00"
    for n, minute in enumerate((7, 8, 60, 61, 700)):
        rows = [(i * (n + 3) % 520, at(minute - i % 40)) for i in range(300)]
        feed.add([*rows, (None, at(minute)), (7, at(minute))])
        stream = timers.stream_missed_slots(schedules, feed.stream(), t0, t1, "40 minutes")
        got, most = run_and_count_state(stream, out, checkpoint)
        assert most < 100
        batch = U.missed_slots(schedules, session.read.parquet(feed.path), t0, t1).join(
            schedules.select("schedule_id", "every_seconds"), "schedule_id")
        over = F.expr("slot_start + make_dt_interval(0, 0, 0, every_seconds)") <= F.lit(at(minute - 40))
        want = batch.where(over).select("schedule_id", "slot", "slot_start")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 10_000


def test_a_value_is_forgotten_after_its_time(session, tmp_path):
    feed = Feed(session, tmp_path, "k string, v long")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    counts = []
    for pause, ttl in ((0, 3), (0, 3), (5, 3)):
        time.sleep(pause)
        feed.add([("a", 1), ("a", 1), ("b", 1), ("a", None), (None, 2)])
        got = ops.run_once_to_table(timers.first_seen(feed.stream(), "k", "v", ttl),
                                    out, checkpoint)
        counts.append(sorted(tuple(r) for r in got.collect()))
    assert counts[0] == [("a", "1"), ("b", "1")]
    assert len(counts[2]) in (4, 6)  # once more after the pause; also before it on a slow machine
