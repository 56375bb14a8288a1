"""A weekday report over files that are added, replaced and withdrawn.

Each file has partial sums of its own, kept below ``store``; a report is merged from the partials of the
files that are there. A file that is replaced or withdrawn takes its partials with it: nothing is
subtracted, so sums of doubles do not drift, and only new and replaced files are read.

``store/partials/version=N`` holds the partials of the files that refresh N read; ``store/manifest``
is published in versions and names, for every file taken in, the version that holds its partials. The
manifest comes last, so a refresh that fails half way is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.sources import sinks

MANIFEST = "file string, path string, modified timestamp, size long, version long"
SUMS = ("amount", "distance")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file, path, modified, size of every file below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path",
                        F.col("_metadata.file_modification_time").alias("modified"),
                        F.col("_metadata.file_size").alias("size"))


def partial_report(rows: DataFrame, ts_col: str, amount_col: str, distance_col: str,
                   count_col: str) -> DataFrame:
    """Per file and weekday: sums and the numbers of values they are of."""
    return rows.groupBy(F.col("_metadata.file_path").alias("file"),
                        F.dayofweek(ts_col).alias("day_of_week")).agg(
        F.sum(amount_col).alias("amount"), F.count(amount_col).alias("n_amount"),
        F.sum(distance_col).alias("distance"), F.count(distance_col).alias("n_distance"),
        F.sum(count_col).alias("passengers"))


def merge_report(partials: DataFrame) -> DataFrame:
    """The weekday report; means without any value are null."""
    means = {c: F.try_divide(F.sum(c), F.sum(f"n_{c}")) for c in SUMS}
    return partials.groupBy("day_of_week").agg(
        means["amount"].alias("avg_amount"), means["distance"].alias("avg_trip_distance"),
        F.sum("passengers").alias("total_passengers"))


def current_partials(spark: SparkSession, store: str) -> DataFrame:
    """The partials of the files that the newest manifest names."""
    kept = sinks.read_published(spark, f"{store}/manifest").select("file", "version")
    partials = spark.read.option("basePath", f"{store}/partials").parquet(f"{store}/partials")
    return partials.withColumn("version", F.col("version").cast("long")).join(kept, ["file", "version"])


def refresh_corrected(spark: SparkSession, path: str, store: str,
                      read: Callable[[list[str]], DataFrame],
                      ts_col: str = "tpep_pickup_datetime", amount_col: str = "total_amount",
                      distance_col: str = "trip_distance",
                      count_col: str = "passenger_count") -> DataFrame:
    """Bring the report up to date with the files below ``path``, and return it.

    ``read`` gives the rows of some files; it is called for new and replaced ones only. A file counts as
    replaced if its time or its size is another one. With no files there are no rows.
    """
    last = sinks.last_published(spark, f"{store}/manifest")
    known = (sinks.read_published(spark, f"{store}/manifest") if last is not None
             else spark.createDataFrame([], MANIFEST))
    version = 0 if last is None else last + 1
    same = ["file", "modified", "size"]
    now = list_files(spark, path)
    changed = now.join(known, same, "left_anti").withColumn("version", F.lit(version).cast("long"))
    stays = known.join(now.select(same), same, "left_semi")
    paths = [r["path"] for r in changed.select("path").collect()]
    partials = f"{store}/partials/version={version}"
    if paths or last is None:
        rows = read(paths) if paths else None
        out = (partial_report(rows, ts_col, amount_col, distance_col, count_col) if paths
               else spark.createDataFrame([], PARTIALS))
        out.write.mode("overwrite").parquet(partials)
    manifest = stays.unionByName(changed).select("file", "path", "modified", "size", "version")
    sinks.publish(manifest, f"{store}/manifest", version)
    return merge_report(current_partials(spark, store))


PARTIALS = ("file string, day_of_week int, amount double, n_amount long, distance double, "
            "n_distance long, passengers long")


def compact_partials(spark: SparkSession, store: str) -> None:
    """Put the partials of all versions that are still of use into one new version.

    The old versions stay for readers of the manifests before; ``drop_unused`` removes them later.
    """
    last = sinks.last_published(spark, f"{store}/manifest")
    version = last + 1
    rows = current_partials(spark, store).drop("version")
    rows.write.mode("overwrite").parquet(f"{store}/partials/version={version}")
    manifest = (sinks.read_published(spark, f"{store}/manifest")
                .withColumn("version", F.lit(version).cast("long")))
    sinks.publish(manifest, f"{store}/manifest", version)


def drop_unused(spark: SparkSession, store: str) -> list[int]:
    """Delete the partials that no manifest still to be found names; returns their versions."""
    used = {r["version"] for m in sinks.published(spark, f"{store}/manifest") for r in
            spark.read.parquet(f"{store}/manifest/version={m}").select("version").distinct().collect()}
    newest = sinks.last_published(spark, f"{store}/manifest")
    gone = [v for v in sinks.published(spark, f"{store}/partials") if v not in used and v <= newest]
    for v in gone:
        sinks.remove(spark, f"{store}/partials/version={v}")
    return gone
