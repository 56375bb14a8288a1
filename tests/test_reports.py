"""The report pipeline, its sinks, connectors and jobs."""

import datetime
import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runloom import schemas
from runloom.plans import jobs
from runloom.plans import report as R
from runloom.session import open_session, scratch_dir, shared_dir
from runloom.sources import connectors as C
from runloom.sources import files, sinks
from runloom.sources.generated import generated_ids, hashed_points, pi_estimate

HEADER = ",".join(f.name for f in schemas.TRIPS)


def trip(vendor="1", pickup="2024-01-06 10:00:00", passengers="2", distance="1.5", amount="10.0"):
    return f"{vendor},{pickup},{pickup},{passengers},{distance},1,N,0,0,1,1,0,0,0,0,0,{amount},0"


@pytest.fixture()
def csv_path(tmp_path):
    """A Saturday, two Sundays, bad and empty fields."""
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "one.csv").write_text("\n".join([
        HEADER, trip(), trip(pickup="2024-01-07 00:00:00", amount="20.0"),
        trip(vendor="2", pickup="2024-01-07 23:59:59", passengers="3.0", amount="30.0")]) + "\n")
    (folder / "two.csv").write_text("\n".join([
        HEADER, trip(pickup="not a time"), trip(vendor="", pickup="", passengers="4", amount=""),
        trip(pickup="2024-01-08 08:00:00", passengers="")]) + "\n")
    return str(folder)


EXPECTED = {7: (10.0, 1.5, 2), 1: (25.0, 1.5, 2), None: (10.0, 1.5, 6), 2: (10.0, 1.5, None)}


def report_rows(df):
    return {r["day_of_week"]: (r["avg_amount"], r["avg_trip_distance"], r["total_passengers"])
            for r in df.collect()}


def test_csv_keeps_rows_with_bad_fields(spark, csv_path):
    trips = files.read_csv(spark, csv_path, schemas.TRIPS)
    assert trips.schema == schemas.TRIPS and trips.count() == 6
    assert trips.where("tpep_pickup_datetime IS NULL").count() == 2
    assert trips.where("passenger_count IS NULL").count() == 2  # '3.0' and an empty field
    assert report_rows(R.weekday_report(trips)) == EXPECTED


def test_generated_names(spark, csv_path):
    trips = files.read_csv(spark, csv_path, schemas.TRIPS)
    report = R.plain_report(trips, "tpep_pickup_datetime", "total_amount", "trip_distance",
                            "passenger_count")
    assert report.columns == ["dayofweek(tpep_pickup_datetime)", "avg(total_amount)",
                              "avg(trip_distance)", "sum(passenger_count)"]


def test_pipeline_runs_twice(spark, csv_path, tmp_path):
    for _ in range(2):
        report = R.run_report_pipeline(spark, csv_path, "trips_twice", "trips_twice_report",
                                       str(tmp_path / "t"), str(tmp_path / "r"))
        assert report_rows(report) == EXPECTED
    table = spark.table("trips_twice")
    assert table.columns[-1] == "day_of_week" and table.count() == 6
    assert glob.glob(str(tmp_path / "t" / "day_of_week=__HIVE_DEFAULT_PARTITION__"))
    detail = {r["col_name"]: r["data_type"] for r in
              spark.sql("DESCRIBE EXTENDED trips_twice").collect()}
    assert detail["Num Buckets"] == "4" and detail["Bucket Columns"] == "[`VendorID`]"


def test_drop_table_is_quiet_and_leaves_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    sinks.write_table(spark.range(3), "dropped_table", path)
    sinks.drop_table(spark, "dropped_table")
    sinks.drop_table(spark, "dropped_table")
    assert spark.read.parquet(path).count() == 3


def test_csv_report_again_over_itself(spark, tmp_path):
    for n in (5, 3):
        sinks.write_csv(spark.range(n), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), spark.range(0).schema).count() == 3


def test_insert_overwrite_leaves_other_partitions_and_settings(spark, tmp_path):
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    sinks.write_table(rows, "overwritten", str(tmp_path / "o"), partition_by=["p"])
    sinks.insert_overwrite(spark.range(1).select((F.col("id") + 100).alias("id"),
                                                 F.lit(0).cast("long").alias("p")), "overwritten")
    assert sorted(r["id"] for r in spark.table("overwritten").collect()) == [1, 3, 5, 7, 9, 100]
    assert spark.conf.get(mode) == before


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "pub")
    for version in (0, 1, 1):
        sinks.publish(spark.range(version + 2), path, version)
    assert sinks.read_published(spark, path).count() == 3
    (tmp_path / "pub" / "version=9").mkdir()  # a write that never ended
    for version in range(2, 8):
        sinks.publish(spark.range(version), path, version)
    assert sinks.read_published(spark, path).count() == 7
    assert sorted(p.name for p in (tmp_path / "pub").iterdir()) == [
        "version=5", "version=6", "version=7", "version=9"]
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "none"))


def test_pi_is_repeatable(spark):
    a, b = [pi_estimate(hashed_points(generated_ids(spark, 200_000, s), "id")).first()
            for s in (3, 8)]
    assert a == b and abs(a["pi"] - 3.14159) < 0.01


# --- connectors ------------------------------------------------------------------------------

def test_object_store_settings():
    conf = C.ObjectStore("h", 9000, "Path").conf()
    assert conf == {"spark.hadoop.fs.s3a.endpoint": "http://h:9000",
                    "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
                    "spark.hadoop.fs.s3a.path.style.access": "true"}
    other = C.ObjectStore("h", access_style="VirtualHosted", tls="").conf()
    assert other["spark.hadoop.fs.s3a.endpoint"] == "https://h"
    assert other["spark.hadoop.fs.s3a.path.style.access"] == "false"
    with pytest.raises(ValueError):
        C.ObjectStore(port=1).conf()


def test_catalog_settings_and_overrides(spark):
    catalog = C.Catalog("lake", "org.example.LakeCatalog", {"type": "hadoop", "warehouse": "s3a://w"},
                        {"spark.sql.catalog.lake.type": "hive"})
    assert catalog.conf() == {"spark.sql.catalog.lake": "org.example.LakeCatalog",
                              "spark.sql.catalog.lake.type": "hive",
                              "spark.sql.catalog.lake.warehouse": "s3a://w"}
    child = open_session(spark)
    catalog.register(child)
    assert child.conf.get("spark.sql.catalog.lake.warehouse") == "s3a://w"
    assert spark.conf.get("spark.sql.catalog.lake", None) is None
    with pytest.raises(ValueError):
        C.Catalog("lake", "").conf()


def test_namespaces_and_three_part_names(spark):
    child = open_session(spark)
    C.use_namespace(child, "spark_catalog.report_ns", create=True)
    sinks.write_table(child.range(4), "spark_catalog.default.source_rows")
    for _ in range(2):
        C.copy_table(child, "spark_catalog.default.source_rows", "spark_catalog.report_ns.copy")
    assert child.sql("SELECT * FROM copy").count() == 4
    assert child.catalog.currentDatabase() == "report_ns"
    assert spark.catalog.currentDatabase() == "default"
    with pytest.raises(Exception, match="SCHEMA_NOT_FOUND|CATALOG_NOT_FOUND"):
        C.use_namespace(child, "no_such_catalog.x")


def test_jdbc_options():
    one = C.jdbc_options("jdbc:x", "t", "d.D")
    assert one == {"url": "jdbc:x", "dbtable": "t", "driver": "d.D", "fetchsize": "10000"}
    split = C.jdbc_options("jdbc:x", "t", "d.D", "id", 0, 100, 4, user="u")
    assert split["numPartitions"] == "4" and split["upperBound"] == "100" and split["user"] == "u"
    with pytest.raises(ValueError):
        C.jdbc_options("jdbc:x", "t", "d.D", "id", 0)


# --- jobs and sessions -----------------------------------------------------------------------

def test_split_statements():
    text = """-- a comment; with a semicolon
    SELECT ';' AS a, "x;y" AS b, `c;d` FROM t; /* one; two */
    SELECT /*+ BROADCAST(t) */ 1 - 2 / 3, 'it\\'s; fine';;
    """
    assert jobs.split_statements(text) == [
        "SELECT ';' AS a, \"x;y\" AS b, `c;d` FROM t",
        "SELECT /*+ BROADCAST(t) */ 1 - 2 / 3, 'it\\'s; fine'"]


def test_nested_comments_and_blocks_stay_whole():
    text = """/* a /* b; */ c; */ SELECT 1;
    BEGIN DECLARE x INT; SET x = CASE WHEN true THEN 1 ELSE 2 END;
      IF x > 0 THEN SELECT if(x > 1, 1, 2); END IF; END;
    BEGIN SELECT 1; BEGIN SELECT 2; END; END; SELECT "/*" AS b, '*/' AS c -- end; of it
    """
    got = jobs.split_statements(text)
    assert [s.split()[0] for s in got] == ["SELECT", "BEGIN", "BEGIN", "SELECT"]
    assert got[0] == "SELECT 1" and got[1].endswith("END IF; END") and got[3].endswith("AS c")


def test_a_query_in_the_middle_that_fails_stops_the_job(spark):
    child = open_session(spark)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        jobs.run_statements(child, "SELECT 1 / id FROM range(3); CREATE TEMPORARY VIEW after AS SELECT 1")
    assert not child.catalog.tableExists("after")


def test_a_copy_never_loses_its_target(spark):
    child = open_session(spark)
    sinks.write_table(child.range(4), "copied_from")
    C.copy_table(child, "copied_from", "copied_to")
    with pytest.raises(ValueError):
        C.copy_table(child, "copied_to", "spark_catalog.default.COPIED_TO")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        C.copy_table(child, "no_such_source", "copied_to")
    assert child.table("copied_to").count() == 4


def test_statements_run_in_order_and_stop_at_the_first_failure(spark):
    child = open_session(spark)
    out = jobs.run_statements(child, """
        CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS n;
        SELECT n + :more AS m FROM v;""", {"more": 41})
    assert out.first()["m"] == 42
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        jobs.run_statements(child, ["SELECT * FROM missing_view",
                                    "CREATE TEMPORARY VIEW late AS SELECT 1"])
    assert not child.catalog.tableExists("late")
    for empty in (None, "", " ; -- nothing"):
        with pytest.raises(ValueError):
            jobs.run_statements(child, empty)


def test_sql_file(spark, tmp_path):
    path = tmp_path / "job.sql"
    path.write_text("-- job\nDROP TABLE IF EXISTS from_file;\n"
                    "CREATE TABLE from_file USING parquet AS SELECT id FROM range(5);\n"
                    "SELECT count(*) AS n\nFROM from_file;")
    for _ in range(2):
        assert jobs.run_sql_file(spark, str(path)).first()["n"] == 5
    with pytest.raises(ValueError):
        jobs.run_sql_file(spark, None)


def test_python_job(spark):
    out = jobs.run_job(spark, lambda s, p: s.range(p["n"]), {"n": 3})
    assert out.count() == 3
    with pytest.raises(ValueError):
        jobs.run_job(spark, None)


def test_sessions_share_tables_but_not_views(spark):
    a, b = open_session(spark, {"spark.sql.shuffle.partitions": "3"}), open_session(spark)
    a.range(2).createOrReplaceTempView("mine")
    sinks.write_table(a.range(2), "shared_by_sessions")
    assert b.table("shared_by_sessions").count() == 2
    assert not b.catalog.tableExists("mine")
    assert a.conf.get("spark.sql.shuffle.partitions") == "3"
    assert b.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_scratch_is_below_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(shared_dir(spark) + "/")


def test_shared_folder_is_made_in_local_mode_only():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder + "/"

    def session(master):
        return SimpleNamespace(conf={}, sparkContext=Context(master))

    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local) and not shared_dir(local).endswith("/")
    with pytest.raises(ValueError):
        shared_dir(session("yarn"))


def test_sum_overflow_is_an_error(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 1.0, 1.0, 2 ** 63 - 1)] * 2,
                               "t timestamp, a double, d double, n long")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        R.weekday_report(df, "t", "a", "d", "n").collect()
