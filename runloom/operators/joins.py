"""Joins on order instead of equality, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import (MAX_ROWS, rows_only, slice_hot_keys, with_carried,
                                      within)


# The level of ranges without an end.
OPEN = -1
# Points, and such ranges, that one cell of theirs holds.
OPEN_ROWS = 10_000
# Rows that may be broadcast. The planner's own guess does not see how often rows are placed.
BROADCAST_ROWS = 100_000


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str,
              right_order: str, columns: dict[str, str],
              max_rows: int = MAX_ROWS) -> DataFrame:
    """For each left row, columns of the newest right row of its key at or before its time.

    ``columns`` maps output names to columns of ``right``; ``right_order`` settles equal times. Both
    inputs are merged into one ordered sequence per key: linear, and whole for left rows
    without a match (NULL). As in any join on conditions, NULL keys and NULL times match nothing.
    """
    right = right.where(reduce(and_, [F.col(c).isNotNull() for c in [*keys, ts]]))
    newest = F.struct(*[F.col(source).alias(out) for out, source in columns.items()])
    sides = (left.withColumn("_side", F.lit(1))
             .unionByName(right.select(*keys, ts, newest.alias("_found"),
                                       F.col(right_order).alias("_tie"), F.lit(0).alias("_side")),
                          allowMissingColumns=True))
    order = [ts, "_side", "_tie"]
    sliced = slice_hot_keys(sides, keys, order, max_rows)
    newest_of_slice = F.max_by(
        "_found", F.when(F.col("_side") == 0, F.struct(ts, "_tie"))).alias("_newest")
    seeded = with_carried(
        sliced, keys, [newest_of_slice],
        lambda w: [F.last("_newest", ignorenulls=True).over(w).alias("_found")])
    w = within(sliced, keys, order)
    found = F.last("_found", ignorenulls=True).over(w)
    # NULL keys have no right rows; a NULL time is first in its key, before every right row.
    return (rows_only(seeded.withColumn("_hit", found), max_rows).where(F.col("_side") == 1)
            .select(*left.columns, *[F.col(f"_hit.{out}").alias(out) for out in columns]))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str,
               width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``low <= point < high``.

    Both sides are put on a grid: a point is in one cell, a range in the one or two cells it touches.
    Cells are ``width`` wide, and twice, four times, ... as wide for longer ranges, so that no range
    is spread over many cells; a point is placed once per cell size that occurs (a few numbers, read
    before the join). The cell turns the range condition into an equi-join, which the planner can
    broadcast, sort-merge, and split where a cell is hot.

    A range that is open on one or both sides (infinite ends) is a level of its own. Both its ranges and
    the points are counted and dealt into shares of about ``OPEN_ROWS`` by their hash, and every share of
    points meets every share of ranges in a cell of its own. Rows are copied as often as the other side
    has shares: once for a small one. NULL ends match nothing, like NULL points.
    """
    infinite = F.lit(float("inf"))
    def cell(value: Column, level: Column) -> Column:
        return F.floor(value / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("long")

    span = F.col(high).cast("double") - F.col(low).cast("double")
    closed = span < infinite
    longer = F.ceil(F.log2(span / F.lit(float(width))))
    placed = (ranges.where(F.col(low) < F.col(high))
              .withColumn("_level", F.when(closed, F.greatest(longer, F.lit(0)).cast("int"))
                          .otherwise(F.lit(OPEN))))
    sizes = {row["_level"]: row["count"] for row in placed.groupBy("_level").count().collect()}
    levels = sorted(sizes)
    unbounded = sizes.get(OPEN, 0)
    known = points.count() if unbounded else None
    shares, deals = -(-(known or 1) // OPEN_ROWS), -(-(unbounded or 1) // OPEN_ROWS)

    def dealt(df: DataFrame, into: int) -> Column:
        # Hashes have no form for maps.
        hashed = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind]
        return F.pmod(F.xxhash64(*hashed), F.lit(into).cast("long"))

    def every(n: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    open_level = F.col("_level") == OPEN
    first, last = cell(F.col(low), F.col("_level")), cell(F.col(high), F.col("_level"))
    deal = dealt(ranges, deals)
    placed = placed.withColumn("_cell", F.explode(
        F.when(open_level, F.transform(every(shares), lambda share: share * deals + deal))
        .otherwise(F.sequence(first, last))))
    share = dealt(points, shares)
    keyed = (points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])
                                                   .cast("array<int>")))
             .where(open_level | (F.abs(F.col(point).cast("double")) < infinite))
             .withColumn("_cell", F.explode(
                 F.when(open_level, F.transform(every(deals), lambda deal: share * deals + deal))
                 .otherwise(F.array(cell(F.col(point), F.col("_level")))))))
    if known is not None and known * (len(levels) - 1 + deals) <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    elif sum(2 * n for n in sizes.values()) + unbounded * shares > BROADCAST_ROWS:
        placed = placed.hint("merge")
    return (keyed.join(placed, [*on, "_level", "_cell"])
            .where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
            .drop("_level", "_cell"))
