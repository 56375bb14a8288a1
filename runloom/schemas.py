"""Declared schemas. Column names and types are fixed values that users' files already have."""

from __future__ import annotations

from pyspark.sql import types as T

TRIPS = T.StructType([
    T.StructField("VendorID", T.LongType()),
    T.StructField("tpep_pickup_datetime", T.TimestampType()),
    T.StructField("tpep_dropoff_datetime", T.TimestampType()),
    T.StructField("passenger_count", T.LongType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("RatecodeID", T.LongType()),
    T.StructField("store_and_fwd_flag", T.StringType()),
    T.StructField("dropoff_longitude", T.DoubleType()),
    T.StructField("dropoff_latitude", T.DoubleType()),
    T.StructField("payment_type", T.LongType()),
    T.StructField("fare_amount", T.DoubleType()),
    T.StructField("extra", T.DoubleType()),
    T.StructField("mta_tax", T.DoubleType()),
    T.StructField("tip_amount", T.DoubleType()),
    T.StructField("tolls_amount", T.DoubleType()),
    T.StructField("improvement_surcharge", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("congestion_surcharge", T.DoubleType()),
])

WEEKDAY_REPORT = T.StructType([
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("avg_amount", T.DoubleType()),
    T.StructField("avg_trip_distance", T.DoubleType()),
    T.StructField("total_passengers", T.LongType()),
])

METRIC_SAMPLE = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("line", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

STATUS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("spark_application_id", T.StringType()),
    T.StructField("submission_id", T.StringType()),
    T.StructField("last_submission_attempt_time", T.StringType()),
    T.StructField("termination_time", T.StringType()),
    T.StructField("driver_info", T.StructType([
        T.StructField("pod_name", T.StringType()),
        T.StructField("web_uiaddress", T.StringType()),
    ])),
    T.StructField("application_state", T.StructType([
        T.StructField("state", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ])),
    T.StructField("executor_state", T.MapType(T.StringType(), T.StringType())),
    T.StructField("execution_attempts", T.IntegerType()),
    T.StructField("submission_attempts", T.IntegerType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("owners", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
    ]))),
    T.StructField("ttl_seconds", T.LongType()),
])

SCHEDULES = T.StructType([
    T.StructField("schedule_id", T.LongType()),
    T.StructField("every_seconds", T.LongType()),
    T.StructField("suspend", T.BooleanType()),
    T.StructField("concurrency_policy", T.StringType()),
    T.StructField("successful_limit", T.IntegerType()),
    T.StructField("failed_limit", T.IntegerType()),
    T.StructField("retry_interval_seconds", T.LongType()),
    T.StructField("max_retries", T.IntegerType()),
    T.StructField("retry_type", T.StringType()),
    T.StructField("submission_interval_seconds", T.LongType()),
    T.StructField("max_submission_retries", T.IntegerType()),
])

RUNS = T.StructType([
    T.StructField("schedule_id", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("start", T.TimestampType()),
    T.StructField("end", T.TimestampType()),
    T.StructField("outcome", T.StringType()),
])

DEPENDENCIES = T.StructType([
    T.StructField("app", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
])

THRESHOLD_RULES = T.StructType([
    T.StructField("prefix", T.StringType()),
    T.StructField("min_level", T.StringType()),
])
