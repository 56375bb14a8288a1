"""User-defined functions in the vectorised forms Spark offers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def damped():
    """ln(1 + x) as a scalar pandas UDF."""
    @F.pandas_udf("double")
    def log1p(values: pd.Series) -> pd.Series:
        return np.log1p(values)
    return log1p


def mean_and_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """A user-defined aggregate: count, mean and standard deviation per key.

    pandas sees one Arrow batch at a time and returns its count, mean and sum of squares around that
    mean for each key; Spark puts the parts together. Sums are taken around a value of the key's own,
    so that large values with a small spread lose no digits. No group is ever brought together in one
    Python process; a key without values has count 0 and no mean.
    """
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby("k", dropna=False)["v"]
            yield pd.DataFrame({"n": grouped.count(), "mean": grouped.mean(),
                                "m2": grouped.var(ddof=0) * grouped.count()}).reset_index()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    partial = rows.mapInPandas(parts, f"k {kind}, n long, mean double, m2 double").where("n > 0")
    # A value of the key itself is near its mean, so differences from it are small numbers.
    near = rows.groupBy("k").agg(F.min("v").alias("near")).withColumnRenamed("k", "near_k")
    apart = F.col("mean") - F.col("near")
    merged = (near.join(partial, F.col("k").eqNullSafe(F.col("near_k")), "left")
              .groupBy("near_k", "near").agg(
                  F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                  F.sum(F.col("n") * apart).alias("total"),
                  F.sum(F.col("m2") + F.col("n") * apart * apart).alias("squares")))
    mean = F.col("total") / F.nullif("n", F.lit(0))
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0))
    return merged.select(
        F.col("near_k").alias(key), "n", (F.col("near") + mean).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0)))).alias("sd"))


@F.udtf(returnType="place int, chars int")
class SplitLines:
    """A table function: one row per line of a text; a missing text has no lines."""

    def eval(self, text: str):
        for place, line in enumerate(text.split("\n") if text is not None else ()):
            yield place, len(line)
