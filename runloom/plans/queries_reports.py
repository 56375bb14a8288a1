"""Registered queries: the report pipeline, its sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runloom import schemas
from runloom.plans import jobs
from runloom.plans import report as R
from runloom.plans import stand_ins as S
from runloom.plans.registry import query, table
from runloom.session import open_session, scratch_dir
from runloom.sources import connectors, files, sinks
from runloom.sources.generated import hashed_points, pi_estimate

REPORT_SQL = """
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week,
       round(avg(l_extendedprice), 6) AS avg_amount,
       round(avg(l_quantity), 6) AS avg_trip_distance,
       CAST(sum(l_linenumber) AS BIGINT) AS total_passengers
FROM lineitem GROUP BY 1"""


def rounded(report):
    """Sums of doubles depend on their order in the last digits."""
    return report.withColumns({c: F.round(c, 6) for c in ("avg_amount", "avg_trip_distance")})


def new_table(spark, name: str) -> tuple[str, str]:
    """A table name of its own, and its path in the shared folder."""
    return f"{name}_{uuid.uuid4().hex[:12]}", scratch_dir(spark, name)


@query("weekday_report", REPORT_SQL)
def weekday_report(spark, d):
    return rounded(R.weekday_report(S.trips(spark, d)))


@query("weekday_report_unnamed", """
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS "dayofweek(tpep_pickup_datetime)",
       round(avg(l_extendedprice), 6) AS "avg(total_amount)",
       round(avg(l_quantity), 6) AS "avg(trip_distance)",
       CAST(sum(l_linenumber) AS BIGINT) AS "sum(passenger_count)"
FROM lineitem GROUP BY 1""")
def weekday_report_unnamed(spark, d):
    out = R.plain_report(S.trips(spark, d), "tpep_pickup_datetime", "total_amount",
                         "trip_distance", "passenger_count")
    return out.withColumns({c: F.round(f"`{c}`", 6)
                            for c in ("avg(total_amount)", "avg(trip_distance)")})


@query("derive_weekday", f"""
SELECT *, CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS day_of_week
FROM ({S.TRIPS_SQL})""")
def derive_weekday(spark, d):
    return R.add_weekday(S.trips(spark, d), "tpep_pickup_datetime")


def trips_as_csv(spark, d) -> str:
    path = scratch_dir(spark, "trips_csv")
    sinks.write_csv(S.trips(spark, d), path)
    return path


def csv_trips(spark, d):
    """The stand-in through CSV files and back, with a declared schema."""
    columns = list(S.TRIP_COLUMNS)
    schema = schemas.T.StructType([schemas.TRIPS[c] for c in columns])
    return files.read_csv(spark, trips_as_csv(spark, d), schema)


@query("csv_scan", S.TRIPS_SQL)
def csv_scan(spark, d):
    return csv_trips(spark, d).withColumn(
        "tpep_pickup_datetime", F.col("tpep_pickup_datetime").cast("timestamp_ntz"))


@query("csv_scan_full", f"""
SELECT * REPLACE (nullif(store_and_fwd_flag, '') AS store_and_fwd_flag) FROM ({S.FULL_TRIPS_SQL})""")
def csv_scan_full(spark, d):
    """All 18 columns of the trip files, with fields that are hard on a CSV reader.

    An empty text comes back as NULL: Spark's reader takes an empty field for one, quoted or not.
    """
    path = scratch_dir(spark, "full_trips_csv")
    sinks.write_csv(S.full_trips(spark, d), path)
    rows = files.read_csv(spark, path, schemas.TRIPS)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz")
                             for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})


@query("csv_report_roundtrip", REPORT_SQL)
def csv_report_roundtrip(spark, d):
    path = scratch_dir(spark, "report_csv")
    for _ in range(2):  # a rerun replaces the first result
        sinks.write_csv(rounded(R.weekday_report(S.trips(spark, d))), path)
    return files.read_csv(spark, path, schemas.WEEKDAY_REPORT)


@query("parquet_report_roundtrip", REPORT_SQL)
def parquet_report_roundtrip(spark, d):
    name, path = new_table(spark, "report_table")
    for _ in range(2):
        sinks.write_table(rounded(R.weekday_report(S.trips(spark, d))), name, path)
    return spark.table(name)


WEEKDAY_TRIPS_SQL = f"""
SELECT *, CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS day_of_week
FROM ({S.TRIPS_SQL})"""


@query("partitioned_table", WEEKDAY_TRIPS_SQL)
def partitioned_table(spark, d):
    name, path = new_table(spark, "trips_by_day")
    day = R.add_weekday(S.trips(spark, d), "tpep_pickup_datetime")
    sinks.write_table(sinks.cluster_for_write(day, "day_of_week", "VendorID"), name, path,
                      partition_by=["day_of_week"])
    return spark.table(name)


@query("bucketed_table", WEEKDAY_TRIPS_SQL)
def bucketed_table(spark, d):
    name, path = new_table(spark, "trips_bucketed")
    R.write_partitioned(S.trips(spark, d), name, path)
    return spark.table(name)


@query("clustered_write", """
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week, l_suppkey AS VendorID,
       count(*) AS trips, round(sum(l_extendedprice), 2) AS amount
FROM lineitem GROUP BY 1, 2""")
def clustered_write(spark, d):
    path = scratch_dir(spark, "trips_clustered")
    day = R.add_weekday(S.trips(spark, d), "tpep_pickup_datetime")
    sinks.write_parquet(sinks.cluster_for_write(day, "day_of_week", "VendorID"), path,
                        ["day_of_week"])
    return (spark.read.parquet(path).groupBy("day_of_week", "VendorID")
            .agg(F.count(F.lit(1)).alias("trips"),
                 F.round(F.sum("total_amount"), 2).alias("amount")))


@query("table_scan", "SELECT * FROM orders")
def table_scan(spark, d):
    """A named table over files that are there already; nothing is copied."""
    name, _ = new_table(spark, "orders")
    spark.sql(f"CREATE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{d}/orders.parquet')")
    return spark.sql(f"SELECT * FROM {name}")


@query("report_pipeline_tables", REPORT_SQL)
def report_pipeline_tables(spark, d):
    """CSV files, partitioned and bucketed table, report table: the whole way."""
    name, path = new_table(spark, "trips_full")
    report, report_path = new_table(spark, "trips_full_report")
    R.write_partitioned(csv_trips(spark, d), name, path)
    by_day = R.weekday_report(spark.table(name), weekday_col="day_of_week")
    sinks.write_table(rounded(by_day), report, report_path)
    return spark.table(report)


@query("pi_sampling", """
SELECT count(*) AS points, CAST(sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) AS BIGINT)
       AS inside, round(4.0 * sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) / count(*), 6)
       AS pi
FROM (SELECT CAST((event_id % 2147483648) * 2654435761 % 4294967296 AS DOUBLE) / 4294967296 * 2 - 1
             AS x,
             CAST((event_id % 2147483648) * 2246822519 % 4294967296 AS DOUBLE) / 4294967296 * 2 - 1
             AS y
      FROM events)""")
def pi_sampling(spark, d):
    return pi_estimate(hashed_points(table(spark, d, "events").select("event_id"), "event_id"))


@query("parquet_scan", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07""")
def parquet_scan(spark, d):
    ship = F.col("l_shipdate")
    return (table(spark, d, "lineitem")
            .where((ship >= F.lit("1997-01-01").cast("timestamp_ntz"))
                   & (ship < F.lit("1998-01-01").cast("timestamp_ntz"))
                   & F.col("l_discount").between(0.05, 0.07))
            .select("l_orderkey", "l_partkey", "l_quantity"))


@query("json_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_roundtrip(spark, d):
    events = table(spark, d, "events")
    path = scratch_dir(spark, "events_json")
    # JSON has no type for times; the text form is given, since the default keeps milliseconds.
    form = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    sinks.write_files(events, "json", path, **form)
    return files.read_files(spark, "json", path, events.schema, **form).select(*events.columns)


@query("orc_roundtrip", "SELECT * FROM customer")
def orc_roundtrip(spark, d):
    path = scratch_dir(spark, "customer_orc")
    sinks.write_files(table(spark, d, "customer"), "orc", path)
    return files.read_files(spark, "orc", path)


@query("text_roundtrip", "SELECT count(*) AS lines, CAST(sum(length(props)) AS BIGINT) AS chars FROM events")
def text_roundtrip(spark, d):
    path = scratch_dir(spark, "props_text")
    sinks.write_files(table(spark, d, "events").select(F.col("props").alias("value")), "text", path)
    return files.read_files(spark, "text", path).agg(
        F.count("value").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("insert_overwrite", """
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week,
       count(*) AS trips,
       CAST(sum(CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN 2 * l_linenumber
                     ELSE l_linenumber END) AS BIGINT) AS passengers
FROM lineitem GROUP BY 1""")
def insert_overwrite(spark, d):
    """Double the passenger counts of the two weekend partitions; the other five stay."""
    name, path = new_table(spark, "trips_rewritten")
    day = R.add_weekday(S.trips(spark, d), "tpep_pickup_datetime")
    sinks.write_table(sinks.cluster_for_write(day, "day_of_week", "VendorID"), name, path,
                      partition_by=["day_of_week"])
    weekend = (day.where(F.col("day_of_week").isin(1, 7))
               .withColumn("passenger_count", F.col("passenger_count") * 2))
    sinks.insert_overwrite(sinks.cluster_for_write(weekend, "day_of_week", "VendorID"), name)
    return (spark.table(name).groupBy("day_of_week")
            .agg(F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers")))


# The shape of a scheduled report job: declare, derive and partition, report in a second namespace.
JOB_SCRIPT = """-- a report job; /* it runs again over its own output */
CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}/db';
DROP TABLE IF EXISTS {name}.trips;
CREATE TABLE {name}.trips USING parquet PARTITIONED BY (day_of_week) AS
  SELECT *, dayofweek(tpep_pickup_datetime) AS day_of_week FROM given_trips;
SELECT * FROM {name}.trips /* read /* whole */ by the job, */;
USE {name};
DROP TABLE IF EXISTS report;
CREATE TABLE report USING parquet AS
  SELECT day_of_week, avg(total_amount) AS avg_amount, avg(trip_distance) AS avg_trip_distance,
         sum(passenger_count) AS total_passengers
  FROM trips GROUP BY day_of_week;
SELECT * FROM report;
"""


def job_script(spark, d, name: str) -> tuple[str, str]:
    """The script over the given trips, with names of its own, and its database."""
    S.trips(spark, d).createOrReplaceTempView("given_trips")
    database = f"{name}_{uuid.uuid4().hex[:12]}"
    return JOB_SCRIPT.format(name=database, path=scratch_dir(spark, name)), database


@query("sql_job_report", REPORT_SQL)
def sql_job_report(spark, d):
    child = open_session(spark)
    script, _ = job_script(child, d, "sql_job")
    return rounded(jobs.run_statements(child, script))


@query("sql_file_job", REPORT_SQL)
def sql_file_job(spark, d):
    """The script from a file; then its report is copied into another namespace and read there."""
    child = open_session(spark)
    script, database = job_script(child, d, "sql_file")
    path = scratch_dir(spark, "sql_file_text")
    sinks.write_files(child.createDataFrame([(script,)], "value string").coalesce(1), "text", path)
    jobs.run_sql_file(child, path)
    copied = f"{database}_copy"
    child.sql(f"CREATE DATABASE {copied} LOCATION '{scratch_dir(spark, 'sql_copy')}'")
    for _ in range(2):
        connectors.copy_table(child, f"spark_catalog.{database}.report", f"spark_catalog.{copied}.report")
    connectors.use_namespace(child, f"spark_catalog.{copied}")
    return rounded(child.table("report"))
