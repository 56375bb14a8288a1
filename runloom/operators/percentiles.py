"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import MAX_ROWS, _null_safe_join, running_all, slice_hot_counts


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      percentiles: dict[str, float], max_rows: int = MAX_ROWS) -> DataFrame:
    """Interpolated percentiles ``{new column: share}`` of ``value`` per key.

    The built-in exact percentile holds all distinct values of a group in one buffer. Here values
    are counted, the counts added up along the value, and of each group only the values on both
    sides of each wanted place are kept. A group without values has NULL percentiles.
    """
    known = df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1))
    counts = known.groupBy(*keys, value).agg(n.alias("_n"), n.alias("_rows"), n.alias("_each"))
    placed = running_all(slice_hot_counts(known, counts, keys, value, max_rows), keys, [value],
                         {"_upto": ("_rows", "sum"), "_all": ("_each", "total")}, max_rows=None)

    def holds(place: Column) -> Column:
        """Counting from 0, a value takes the places from _upto - _n to _upto - 1."""
        return (place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto"))

    def around(share: float) -> tuple[Column, Column, Column]:
        place = F.lit(share) * (F.col("_all") - 1)
        return place, F.floor(place), F.ceil(place)

    wanted = [holds(side) for share in percentiles.values() for side in around(share)[1:]]
    outputs = []
    for name, share in percentiles.items():
        place, low, high = around(share)
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(high), F.col(value)))
        outputs.append((at_low + (at_high - at_low) * F.max(place - low)).alias(name))
    found = placed.where(reduce(or_, wanted)).groupBy(*keys).agg(*outputs)
    # One row per group and task, whatever its values; the join keeps groups that have none.
    groups = df.select(*keys).distinct()
    return _null_safe_join(groups, found, keys, "left")
