"""Table and file writers. Each one may be run again over its own earlier output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header row, replacing what an earlier run left at ``path``.

    Blanks around a text are part of it; the writer would cut them off unless told otherwise.
    """
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_files(df: DataFrame, fmt: str, path: str, **options) -> None:
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def drop_table(spark: SparkSession, table: str) -> None:
    """Forget the table if it is there; files of a path-backed table stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def cluster_for_write(df: DataFrame, partition_col: str, key_col: str,
                      buckets: int | None = None) -> DataFrame:
    """Put rows of one table partition next to each other, in key order, before a write.

    A REBALANCE shuffle brings each partition value (and bucket) together, so a writer opens few
    files at a time; AQE then cuts large values into even pieces and joins small ones, so neither a
    few partition values nor one hot key ends up in a single writer. The order inside a writer is
    local: no global sort, no sampling pass.
    """
    if buckets is None:
        return df.hint("rebalance", partition_col).sortWithinPartitions(partition_col, key_col)
    bucket = F.pmod(F.hash(F.col(key_col)), F.lit(buckets))
    return (df.withColumn("_bucket", bucket)
            .hint("rebalance", partition_col, "_bucket")
            .sortWithinPartitions(partition_col, "_bucket", key_col)
            .drop("_bucket"))


def write_table(df: DataFrame, table: str, path: str | None = None, fmt: str = "parquet",
                partition_by: list[str] | None = None,
                bucket_by: tuple[int, str] | None = None) -> None:
    """Create or replace a catalog table from ``df``, partitioned and bucketed as asked."""
    writer = df.write.mode("overwrite").format(fmt)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
    writer.saveAsTable(table)


def insert_overwrite(df: DataFrame, table: str) -> None:
    """Replace only the partitions of a file-based table that ``df`` holds rows for.

    The mode is an option of this one write, to the table's own folder; a setting of the session
    would change what other jobs of the session do meanwhile.
    """
    spark = df.sparkSession
    rows = df.select(*spark.table(table).columns)
    about = {r["col_name"]: r["data_type"]
             for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
     .format(about["Provider"]).save(about["Location"]))
    if parts:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spark.catalog.refreshTable(table)


def publish(df: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write a small report as version ``version`` below ``path``, and drop all but the newest ``keep``.

    Earlier versions stay in place until the new one is complete, so a reader always finds one;
    writing the same version again replaces it. A reader that takes longer than ``keep`` versions
    needs a higher one.
    """
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    for old in published(df.sparkSession, path)[:-keep]:
        remove(df.sparkSession, f"{path}/version={old}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole published version, found by listing the folder."""
    version = last_published(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/version={version}")


def last_published(spark: SparkSession, path: str) -> int | None:
    return max(published(spark, path), default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it names; nothing if it is not there."""
    files, place = _folder(spark, path)
    files.delete(place, True)


def _folder(spark: SparkSession, path: str):
    """A path on whatever file system it names, and that file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def published(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """The numbers of the folders ``name=number`` whose write has been committed, ascending."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    found = [n for n in found if n.startswith(f"{name}=")]
    return sorted(int(n.removeprefix(f"{name}=")) for n in found
                  if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1]))
