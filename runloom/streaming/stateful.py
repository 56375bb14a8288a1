"""User-defined state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def track_activity(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count of rows, sum and highest value per key, updated as rows arrive; NULL without values.

    Rows are added up per key inside each Arrow batch before they are shuffled to the state, so a
    key with a third of the rows sends it one row per batch.
    """
    kind = events.schema[key].dataType.simpleString()
    fields = f"key {kind}, n long, total double, highest double"

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby("key", dropna=False)["value"]
            yield pd.DataFrame({"n": grouped.size(), "total": grouped.sum(min_count=1),
                                "highest": grouped.max()}).reset_index()

    def update(group: tuple, batches: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, highest = state.get if state.exists else (0, None, None)
        for batch in batches:
            n += int(batch["n"].sum())
            known = batch.dropna(subset=["highest"])
            if len(known):
                total = (total or 0.0) + float(known["total"].sum())
                top = float(known["highest"].max())
                highest = top if highest is None else max(highest, top)
        state.update((n, total, highest))
        yield pd.DataFrame({"key": [group[0]], "n": [n], "total": [total], "highest": [highest]})

    rows = events.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    return rows.mapInPandas(add_up, fields).groupBy("key").applyInPandasWithState(
        update, fields, "n long, total double, highest double", "update",
        GroupStateTimeout.NoTimeout)


def read_activity(changes: DataFrame) -> DataFrame:
    """The newest state of each key among the batches written by ``upsert_batches``."""
    newest = changes.groupBy("key").agg(
        F.max_by(F.struct("n", "total", "highest"), "batch").alias("s"))
    return newest.select("key", "s.n", "s.total", "s.highest")
