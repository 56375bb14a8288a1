"""Ordered computations over keys of any size.

A window over a key puts all rows of that key into one task. Here keys are counted first. If none
holds more rows than a task should (the usual case), a plain window does the work. Otherwise the
rows of each large key are cut into slices along the order, and each slice starts with one extra row
that carries what the slices before it add up to. A window over (key, slice) then gives the same
answer as one over the key, while a hot key is spread over as many tasks as it has slices.

Several steps over the same keys and order can share one cut: call ``slice_hot_keys`` first and pass
``max_rows=None`` to the steps, which then take the rows as they are and leave the slices on them.

Cut points are taken from a sample and may fall anywhere in the order, between rows of equal time
too. Where they fall affects balance only, never the result. Both what is collected to find them and
what is broadcast to apply them is bounded: at most ``2 * MOST_SLICES`` slices in all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
CARRIED = "_carried"

# Rows of one key that one task is given at most, unless the largest MOST_SLICES keys have so many
# rows that this would make more than MOST_SLICES slices.
MAX_ROWS = 5_000_000
MOST_SLICES = 4096
_SAMPLED_PER_SLICE = 32


def slice_hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add the slice number of each row, or return ``df`` as it is if no key is too large.

    ``order`` must give every row of a key a place of its own. Counting reads the key columns only.
    """
    if max_rows is None:
        return df
    if SLICE in df.columns:
        raise ValueError("sliced already; pass max_rows=None to use the slices that are there")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.where(F.col("_n") > max_rows).orderBy(F.desc("_n")).limit(MOST_SLICES).collect()
    # Shares of the rows in question only: with very many keys, or keys all alike, none may be above them.
    target = max(max_rows, sum(row["_n"] for row in largest) // MOST_SLICES)
    hot = [row for row in largest if row["_n"] > target]
    if not hot:
        return df
    cuts = _cut_points(df, keys, order, hot, target)
    # Keys without cut points keep all their rows in slice 0.
    joined = _null_safe_join(df, F.broadcast(cuts), keys, "left")
    return _place(joined, F.struct(*order), F.col("_cuts"), max(row["_n"] for row in hot) // target + 2
                  ).drop("_cuts")


def slice_hot_counts(df: DataFrame, counts: DataFrame, keys: Sequence[str], value: str,
                     max_rows: int = MAX_ROWS) -> DataFrame:
    """``slice_hot_keys`` for the distinct values of ``df`` with their ``counts``.

    A key has at most as many values as rows, and rows are counted without a shuffle of the values;
    only if a key has too many rows are its values counted too.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if not most or most <= max_rows:
        return counts
    return slice_hot_keys(counts, keys, [value], max_rows)


def _cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: list,
                target: int) -> DataFrame:
    """Per hot key, an ascending array of order values, about ``target`` rows apart."""
    spark = df.sparkSession
    key_schema = T.StructType([df.schema[k] for k in keys])
    known = spark.createDataFrame([tuple(row[k] for k in keys) for row in hot], key_schema)
    fraction = min(1.0, _SAMPLED_PER_SLICE / target)
    sample = (_null_safe_join(df.select(*dict.fromkeys([*keys, *order])), F.broadcast(known), keys)
              .sample(fraction, seed=17))
    per_slice = max(1, int(target * fraction))
    cuts = sample.groupBy(*keys).agg(F.filter(
        F.sort_array(F.collect_list(F.struct(*order))),
        lambda _, i: (i + 1) % per_slice == 0).alias("_cuts"))
    # Fixed here, so that every use of the slices in a plan sees the same cut points.
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def _place(df: DataFrame, value: Column, bounds: Column, most: int) -> DataFrame:
    """How many bounds are <= value, found by halving: one short step per bit."""
    out = df.withColumn(SLICE, F.lit(0))
    for bit in reversed(range((4 * most).bit_length())):
        size = 1 << bit
        reached = value >= F.get(bounds, F.col(SLICE) + F.lit(size - 1))
        out = out.withColumn(SLICE, F.col(SLICE) + F.when(reached, size).otherwise(0))
    return out


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the keys come once."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def _group(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*keys, SLICE] if SLICE in df.columns else list(keys)


def with_carried(df: DataFrame, keys: Sequence[str], totals: Sequence[Column],
                 carry: Callable[[WindowSpec], Sequence[Column]],
                 backwards: bool = False) -> DataFrame:
    """``df`` plus one carried row per key and slice, marked by the column ``_carried``.

    ``totals`` are named aggregates of one slice. ``carry`` gets the window over the earlier slices
    (the later ones if ``backwards``), nearest last, and returns the columns of the carried row,
    named as the columns of ``df`` they stand for. Without slices there is nothing to carry.
    """
    rows = df.withColumn(CARRIED, F.lit(0))
    if SLICE not in df.columns:
        return rows
    per_slice = df.groupBy(*keys, SLICE).agg(*totals)
    others = (Window.partitionBy(*keys).orderBy(F.desc(SLICE) if backwards else F.asc(SLICE))
              .rowsBetween(Window.unboundedPreceding, -1))
    seeds = per_slice.select(*keys, SLICE, *carry(others), F.lit(1).alias(CARRIED))
    # Rows that come in partitioned by key alone would count as well placed for a window over key
    # and slice, and stay together; hence the explicit shuffle.
    return rows.unionByName(seeds, allowMissingColumns=True).repartition(*keys, SLICE)


def within(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The window over one slice, carried row first."""
    return Window.partitionBy(*_group(df, keys)).orderBy(F.desc(CARRIED), *order)


def rows_only(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Drop the carried rows again, and the slices unless they were there before."""
    rows = df.where(F.col(CARRIED) == 0).drop(CARRIED)
    return rows if max_rows is None else rows.drop(SLICE)


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    columns: dict[str, str], max_rows: int | None = MAX_ROWS) -> DataFrame:
    """For each row, columns of the row before it in its key: ``{new column: column}``."""
    sources = list(dict.fromkeys(columns.values()))
    sliced = slice_hot_keys(df, keys, order, max_rows)
    seeded = with_carried(
        sliced, keys, [F.max_by(F.struct(*sources), F.struct(*order)).alias("_last")],
        lambda w: [F.last("_last").over(w)[source].alias(source) for source in sources])
    w = within(sliced, keys, order)
    return rows_only(seeded.withColumns(
        {name: F.lag(source).over(w) for name, source in columns.items()}), max_rows)


def next_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                columns: dict[str, str], max_rows: int | None = MAX_ROWS) -> DataFrame:
    """For each row, columns of the row after it in its key: ``{new column: column}``."""
    sources = list(dict.fromkeys(columns.values()))
    sliced = slice_hot_keys(df, keys, order, max_rows)
    seeded = with_carried(
        sliced, keys, [F.min_by(F.struct(*sources), F.struct(*order)).alias("_first")],
        lambda w: [F.last("_first").over(w)[source].alias(source) for source in sources],
        backwards=True)
    w = Window.partitionBy(*_group(sliced, keys)).orderBy(CARRIED, *order)
    return rows_only(seeded.withColumns(
        {name: F.lead(source).over(w) for name, source in columns.items()}), max_rows)


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _over(how: str, column: str, w: WindowSpec) -> Column:
    if how == "last":
        return F.last(column, ignorenulls=True).over(w)
    return _AGGREGATES[how](column).over(w)


def running_all(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                outputs: dict[str, tuple[str, str]], include_current: bool = True,
                max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Running values along the order: ``{new column: (column, how)}``.

    ``how`` is ``sum``, ``max``, ``min``, ``last`` (the last value that is not NULL), or ``total``
    (the sum over the whole key, the same on each of its rows). Each source column is used once.
    """
    def of_slice(column: str, how: str) -> Column:
        if how == "last":
            return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
        return _AGGREGATES["sum" if how == "total" else how](column)

    def carried(column: str, how: str, earlier: WindowSpec) -> Column:
        if how == "total":
            return F.sum(f"_of_{column}").over(Window.partitionBy(*keys)).alias(column)
        return _over(how, f"_of_{column}", earlier).alias(column)

    sliced = slice_hot_keys(df, keys, order, max_rows)
    seeded = with_carried(
        sliced, keys, [of_slice(c, how).alias(f"_of_{c}") for c, how in outputs.values()],
        lambda w: [carried(c, how, w) for c, how in outputs.values()])
    ordered = within(sliced, keys, order)
    frame = ordered.rowsBetween(Window.unboundedPreceding,
                                Window.currentRow if include_current else -1)

    def of_row(column: str, how: str) -> Column:
        if how != "total":
            return _over(how, column, frame)
        if SLICE in sliced.columns:
            return F.first(column).over(ordered)  # the carried row's
        return F.sum(column).over(Window.partitionBy(*keys))

    return rows_only(seeded.withColumns(
        {out: of_row(c, how) for out, (c, how) in outputs.items()}), max_rows)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, how: str,
            out: str, include_current: bool = True, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """``running_all`` for one column."""
    return running_all(df, keys, order, {out: (value, how)}, include_current, max_rows)


def _counted(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.lit(1).cast("long") for name in names})


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                out: str = "row_number", size: str | None = None,
                max_rows: int | None = MAX_ROWS) -> DataFrame:
    """1, 2, ... along the order within each key; ``size`` names a column for the key's row count."""
    outputs = {out: ("_one", "sum")} | ({size: ("_each", "total")} if size else {})
    return running_all(_counted(df, "_one", "_each"), keys, order, outputs,
                       max_rows=max_rows).drop("_one", "_each")


def ntiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int,
           out: str = "ntile", max_rows: int | None = MAX_ROWS) -> DataFrame:
    """The rows of each key in ``tiles`` runs of about equal length, the longer ones first."""
    numbered = row_numbers(df, keys, order, "_place", "_size", max_rows)
    place, size = F.col("_place"), F.col("_size")
    short = F.floor(size / tiles)
    longer = size % tiles
    in_longer = longer * (short + 1)
    tile = F.when(place <= in_longer, F.ceil(place / (short + 1))).otherwise(
        longer + F.ceil((place - in_longer) / F.greatest(short, F.lit(1))))
    return numbered.withColumn(out, tile.cast("int")).drop("_place", "_size")


def ranks(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False,
          max_rows: int = MAX_ROWS) -> DataFrame:
    """``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` of ``value`` within each key.

    Ranks depend only on how often each value occurs. So values are counted first, the counts are
    added up along the value, and the ranks are joined back to the rows: a value that a third of
    all rows share is one row of the counts, and AQE splits it in the join.
    """
    n = F.count(F.lit(1))
    counts = df.groupBy(*keys, value).agg(n.alias("_n"), n.alias("_rows"), n.alias("_each"))
    table = running_all(
        _counted(slice_hot_counts(df, counts, keys, value, max_rows), "_values", "_value"),
        keys, [value],
        {"_upto": ("_rows", "sum"), "_dense": ("_values", "sum"), "_all": ("_each", "total"),
         "_distinct": ("_value", "total")}, max_rows=None).drop(SLICE)
    upto, dense = F.col("_upto"), F.col("_dense")
    if descending:
        upto, dense = F.col("_all") - upto + F.col("_n"), F.col("_distinct") - dense + 1
    table = table.select(
        *keys, value, (upto - F.col("_n") + 1).alias("rank"), dense.alias("dense_rank"),
        F.when(F.col("_all") > 1, (upto - F.col("_n")) / (F.col("_all") - 1))
        .otherwise(F.lit(0.0)).alias("percent_rank"),
        (upto / F.col("_all")).alias("cume_dist"))
    return _null_safe_join(df, table, [*keys, value])


def moving_frame(df: DataFrame, keys: Sequence[str], number: str, preceding: int,
                 aggregates: dict[str, Column], slice_rows: int = 1_000_000) -> DataFrame:
    """Aggregates over the current row and ``preceding`` rows before it.

    ``number`` is the row's place in its key (1, 2, ...). Slices hold ``slice_rows`` rows each; the
    last ``preceding`` rows of a slice are also handed to the next one, where they only feed frames.
    """
    if preceding >= slice_rows:
        raise ValueError("a slice must be longer than the frame")
    own = F.floor((F.col(number) - 1) / F.lit(slice_rows))
    place = F.pmod(F.col(number) - 1, F.lit(slice_rows))
    slices = F.when(place >= slice_rows - preceding, F.array(own, own + 1)).otherwise(F.array(own))
    copies = df.withColumn("_own", own).withColumn(SLICE, F.explode(slices))
    w = (Window.partitionBy(*keys, SLICE).orderBy(number)
         .rowsBetween(-preceding, Window.currentRow))
    return (copies.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
            .where(F.col("_own") == F.col(SLICE)).drop("_own", SLICE))


def moving_range(df: DataFrame, keys: Sequence[str], position: str, reach: int,
                 outputs: dict[str, tuple[str, str]], slice_width: int) -> DataFrame:
    """Values over rows whose ``position`` is at most ``reach`` before the current one's.

    ``outputs`` is ``{new column: (column, "sum"|"max"|"min"|"count")}``; ``position`` is a whole
    number, seconds say. Rows of one key and position are added up first, so a burst of any size is
    at most ``slice_width + reach`` rows of a slice. A slice must be at least as wide as the reach:
    each position is then needed in its own slice and at most the next. Rows of a key without a
    position are a frame of their own.
    """
    if reach > slice_width:
        raise ValueError("a slice must be at least as wide as the frame")
    each = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    added = df.groupBy(*keys, position).agg(
        *[each[how](column).alias(f"_part_{out}") for out, (column, how) in outputs.items()])
    own = F.floor(F.col(position) / F.lit(slice_width))
    place = F.pmod(F.col(position), F.lit(slice_width))
    slices = F.when(place >= slice_width - reach, F.array(own, own + 1)).otherwise(F.array(own))
    copies = added.where(F.col(position).isNotNull()).withColumn("_own", own).withColumn(SLICE, F.explode(slices))
    w = (Window.partitionBy(*keys, SLICE).orderBy(position)
         .rangeBetween(-reach, Window.currentRow))
    frames = (copies.withColumns({out: merge[how](f"_part_{out}").over(w)
                                  for out, (_, how) in outputs.items()})
              .where(F.col("_own") == F.col(SLICE)).select(*keys, position, *outputs))
    nowhere = added.where(F.col(position).isNull()).select(
        *keys, position, *[F.col(f"_part_{out}").alias(out) for out in outputs])
    return _null_safe_join(df, frames.union(nowhere), [*keys, position])


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: str,
                   highest_limit: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """The newest ``limit`` rows of each key; the limit is a column, never above ``highest_limit``.

    With a moderate highest limit Spark keeps only that many rows of a key per task before the
    shuffle, however hot the key. Beyond, rows are numbered slice by slice.
    """
    spark = df.sparkSession
    pushed = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if highest_limit <= pushed:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        return (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= highest_limit)
                .where(F.col("_rn") <= F.col(limit)).drop("_rn"))
    numbered = row_numbers(df, keys, order, "_rn", "_size", max_rows)
    return numbered.where(F.col("_size") - F.col("_rn") < F.col(limit)).drop("_rn", "_size")
