"""The weekday report and the pipeline around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import schemas
from runloom.sources import files, sinks


def add_weekday(df: DataFrame, ts_col: str, out: str = "day_of_week") -> DataFrame:
    """All columns plus the weekday, 1 = Sunday to 7 = Saturday."""
    return df.withColumn(out, F.dayofweek(ts_col))


def weekday_report(df: DataFrame, ts_col: str = "tpep_pickup_datetime",
                   amount_col: str = "total_amount", distance_col: str = "trip_distance",
                   count_col: str = "passenger_count",
                   weekday_col: str | None = None) -> DataFrame:
    """Mean amount, mean distance and total count per weekday; rows without a time form one group.

    Each task sends on at most eight partial rows. On a table partitioned by the weekday, name that
    column in ``weekday_col``: the time column is then not read at all.
    """
    weekday = F.col(weekday_col) if weekday_col else F.dayofweek(ts_col)
    return df.groupBy(weekday.alias("day_of_week")).agg(
        F.avg(amount_col).alias("avg_amount"),
        F.avg(distance_col).alias("avg_trip_distance"),
        F.sum(count_col).alias("total_passengers"))


def plain_report(df: DataFrame, ts_col: str, amount_col: str, distance_col: str,
                 count_col: str) -> DataFrame:
    """The same report with the column names Spark gives to unnamed expressions."""
    return df.groupBy(F.dayofweek(ts_col)).agg(
        F.avg(amount_col), F.avg(distance_col), F.sum(count_col))


def write_partitioned(trips: DataFrame, table: str, path: str | None = None,
                      ts_col: str = "tpep_pickup_datetime", key_col: str = "VendorID",
                      buckets: int = 4) -> None:
    """Trips as a Parquet table, partitioned by weekday and bucketed by vendor."""
    clustered = sinks.cluster_for_write(add_weekday(trips, ts_col), "day_of_week", key_col,
                                        buckets)
    sinks.write_table(clustered, table, path, partition_by=["day_of_week"],
                      bucket_by=(buckets, key_col))


def run_report_pipeline(spark: SparkSession, csv_path: str, table: str, report_table: str,
                        table_path: str | None = None,
                        report_path: str | None = None) -> DataFrame:
    """CSV files -> partitioned trip table -> weekday report table. May be run again and again."""
    trips = files.read_csv(spark, csv_path, schemas.TRIPS)
    write_partitioned(trips, table, table_path)
    report = weekday_report(spark.table(table), weekday_col="day_of_week")
    sinks.write_table(report, report_table, report_path)
    return spark.table(report_table)
