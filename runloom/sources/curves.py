"""Files clustered by several columns at once, and readers that open only those that can matter.

Rows are ordered along a Hilbert curve through the cells of all columns: neighbours on the curve are
neighbours in every column, so each file covers a small range of each. A table of every file's ranges is
written beside the files; a filter on any of the columns picks files from it before one is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 8  # cells of a column: 2^BITS, of about equally many rows each


def as_number(df: DataFrame, name: str) -> Column:
    """A column as a double in its own order: numbers, times, dates, and texts by their first bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell numbers, one column per dimension.

    Gray codes of the bits, with the exchanges and inversions that each level asks of the ones below.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def curve_place(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of each row on the curve. Cells are cut at approximate quantiles: 2^bits numbers a column.

    Missing values are in the first cell.
    """
    ranks = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(as_number(df, c), ranks).alias(f"c{i}")
                    for i, c in enumerate(columns)]).first()
    edges = [np.array(cut or [], np.float64) for cut in cuts]

    @F.pandas_udf("long")
    def place(values: pd.DataFrame) -> pd.Series:
        cells = [np.where(values[c].isna(), 0, np.searchsorted(edges[i], values[c], side="right"))
                 for i, c in enumerate(values.columns)]
        return pd.Series(hilbert(np.stack(cells, axis=1), bits))

    return place(F.struct(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]))


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int,
                    bits: int = BITS) -> None:
    """Write ``df`` as about ``files`` files along the curve, with a table of their ranges.

    Files are cut by rows, not by cells: a cell with very many rows is spread by a hash of the row.
    """
    spark = df.sparkSession
    placed = df.withColumn("_place", curve_place(df, columns, bits))
    # All of the row is hashed, as text: hashing has no form for maps.
    whole = F.xxhash64(F.to_json(F.struct(*df.columns)))
    (placed.withColumn("_spread", whole).repartitionByRange(files, "_place", "_spread")
     .sortWithinPartitions("_place").drop("_place", "_spread")
     .write.mode("overwrite").parquet(f"{path}/data"))
    rows = spark.read.schema(df.schema).parquet(f"{path}/data")
    ranges = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    (rows.groupBy(F.col("_metadata.file_path").alias("file"))
     .agg(F.count(F.lit(1)).alias("rows"), *ranges,
          *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns])
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges"))


def clustered_files(spark: SparkSession, path: str, column: str, low=None, high=None) -> list[str]:
    """The files that may hold rows with ``low`` <= column <= ``high``; either end may be open."""
    ranges = spark.read.parquet(f"{path}/ranges")
    if low is not None:
        ranges = ranges.where(F.col(f"max_{column}") >= F.lit(low))
    if high is not None:
        ranges = ranges.where(F.col(f"min_{column}") <= F.lit(high))
    return [r["file"] for r in ranges.select("file").collect()]


def read_clustered(spark: SparkSession, path: str, column: str, low=None, high=None) -> DataFrame:
    """The rows with ``low`` <= column <= ``high``; with neither end, those with any value."""
    schema = spark.read.parquet(f"{path}/data").schema
    files = clustered_files(spark, path, column, low, high)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    rows = rows.where(F.col(column).isNotNull())
    if low is not None:
        rows = rows.where(F.col(column) >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col(column) <= F.lit(high))
    return rows
