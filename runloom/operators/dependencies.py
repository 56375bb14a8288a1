"""Dependencies of jobs, from their own list, their catalogs and their environment sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import MAX_ROWS, row_numbers

# The order in which lists are joined together, and the kinds of lists.
SOURCES = ["own", "catalog", "env_set"]
KINDS = ["jar", "file", "py_file", "package", "excluded_package", "repository"]


def dependency_usage(deps: DataFrame) -> DataFrame:
    """How many applications use each dependency, and how often each source names it."""
    return deps.groupBy("kind", "name").agg(
        F.count_distinct("app").alias("apps"),
        F.count(F.lit(1)).alias("uses"),
        *[F.count_if(F.col("source") == source).alias(f"{source}_uses") for source in SOURCES])


def dependency_order(deps: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The place of every entry, from 0, in its application's joined list of its kind.

    An application has one list of each kind: first its own entries, then those of its catalogs, then
    those of its environment sets, each in the order of ``position``, equal positions by name.
    Duplicates stay. Positions only order; they may have gaps and need not begin anywhere. Entries of
    no known source come last. An application with very many entries is cut into slices.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")),
                      F.lit(0))
    ranked = deps.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(SOURCES) + 1))
    # Entries alike in all of this fall into one slice; which of them comes first makes no difference.
    numbered = row_numbers(ranked, ["app", "kind"], ["_rank", "position", "name"], "_place",
                           max_rows=max_rows)
    return numbered.withColumn("place", F.col("_place") - 1).drop("_rank", "_place")
