"""Exact samples that are the same in every run, on any number of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_hash(key: Column, seed: str) -> Column:
    """A text that orders keys at random, the same for the same seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_hash(key: Column, seed: str) -> Column:
    """A number above 0 and at most 1, by the first 52 bits of the hash."""
    bits = F.conv(F.substring(keyed_hash(key, seed), 1, 13), 16, 10).cast("long")
    return (bits + 1).cast("double") / F.lit(float(2**52))


def _least(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    # Spark keeps the n first rows of a stratum in every task before the shuffle, so a stratum with
    # most of the rows sends no more than any other.
    first = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("_n", first).where(F.col("_n") <= n).drop("_n")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int,
                      seed: str = "0") -> DataFrame:
    """``n`` rows of each stratum, all if there are fewer: those with the smallest keyed hashes.

    ``key`` identifies a row. Samples with the same seed are nested: a smaller one is part of a larger
    one, and rows that stay in the table stay in or out together with their neighbours by hash.
    """
    rows = df.withColumn("_hash", keyed_hash(F.col(key), seed))
    return _least(rows, strata, [F.col("_hash"), F.col(key)], n).drop("_hash")


def weighted_sample(df: DataFrame, strata: Sequence[str], key: str, weight: str, n: int,
                    seed: str = "0") -> DataFrame:
    """``n`` rows of each stratum without putting back, drawn in proportion to their weights.

    Each row's priority is an exponential time with its weight as the rate; the earliest are taken.
    Rows without a positive weight are never drawn.
    """
    rows = (df.where(F.col(weight) > 0)
            .withColumn("_time", -F.ln(unit_hash(F.col(key), seed)) / F.col(weight)))
    return _least(rows, strata, [F.col("_time"), F.col(key)], n).drop("_time")
