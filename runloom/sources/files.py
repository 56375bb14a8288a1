"""File scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             header: bool = True) -> DataFrame:
    """Delimited files under ``path``. A field that does not fit its type is NULL, the row stays."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("mode", "PERMISSIVE").csv(path))


def read_files(spark: SparkSession, fmt: str, path: str,
               schema: T.StructType | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON or text files; give a schema to avoid an inference pass over JSON."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with what is needed to put them back in file order.

    ``file`` and ``block`` name the split a line was read from. ``line_key`` grows along a split;
    it is taken on the scan itself, before anything can move rows.
    """
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line_key"),
                    F.col("value").alias("line")))


def stream_files(spark: SparkSession, fmt: str, path: str, schema: T.StructType,
                 max_files: int | None = None, **options) -> DataFrame:
    """The same files as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
