"""Streams whose results appear because time passes: timers, and state that expires.

Event-time timers are kept with the state of their key and fire once the watermark reaches them, also
after a restart. State is kept in RocksDB; what a timer has dealt with leaves it. A key is a share of the
records, not one record or one name: a share's rows go into the state and out of it together, packed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runloom.functions.times import seconds, to_epoch

# Shares that records are dealt into; each is a key of the state.
SALTS = 1024
# The same for schedules. A checkpoint holds the state by share: another number needs a new checkpoint.
SCHEDULE_SHARES = 1024
# Rows that a timer gives at a time, and that a value of the state holds.
ROWS_AT_ONCE = 10_000
# Bits of milliseconds in a period for which waiting records are kept together: 1 ms, 16 s, 17 minutes,
# 19 hours, 50 days, 9 years.
PERIODS = (0, 14, 20, 26, 32, 38)
# Values of the state that newly started slots are kept in before they are made one.
MOST_PARTS = 16


def frame(rows: Sequence[Sequence], kinds: dict[str, str]) -> pd.DataFrame:
    """Rows as columns of numpy types, which Spark takes from a state's output."""
    return pd.DataFrame({name: pd.Series([row[i] for row in rows], dtype=kind)
                         for i, (name, kind) in enumerate(kinds.items())})


def local_distinct(df: DataFrame) -> DataFrame:
    """Distinct rows of each Arrow batch: a hot key sends few rows into the shuffle before its state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    return df.mapInPandas(run, df.schema)


def pack(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


def cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for low in range(0, len(rows), ROWS_AT_ONCE):
        yield rows.iloc[low:low + ROWS_AT_ONCE]


class _Due(StatefulProcessor):
    """Holds records until the time they are due.

    A record waits in the longest period that it is due in and that has not begun. When the period
    begins, its records move on to shorter ones; so a record moves a few times, whatever its time, and a
    share has few timers and values for any number of records.
    """

    COLUMNS = ["namespace", "app", "event_id", "ttl_seconds", "due"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "bits int, period long", "n int")
        self.waiting = handle.getMapState("waiting", "bits int, period long, part int", "rows binary")

    def _wait(self, rows: pd.DataFrame, now: int) -> None:
        """Keep rows that are due after ``now``."""
        due = rows["due"].to_numpy()
        bits = np.zeros(len(rows), "int64")
        for longer in PERIODS[1:]:
            bits[(due >> longer) << longer > now] = longer
        for (some, period), group in rows.groupby([bits, due >> bits]):
            place = (int(some), int(period))
            n = self.parts.getValue(place)[0] if self.parts.containsKey(place) else 0
            for part in cut(group):
                self.waiting.updateValue((*place, n), (pack(part),))
                n += 1
            self.parts.updateValue(place, (n,))
            self.handle.registerTimer(place[1] << place[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            batch = batch[self.COLUMNS]
            over = batch["due"] <= now
            if over.any():
                yield batch[over]
            self._wait(batch[~over], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for bits in PERIODS:
            place = (bits, begun >> bits)
            if place[1] << bits != begun or not self.parts.containsKey(place):
                continue
            for part in range(self.parts.getValue(place)[0]):
                rows = unpack(self.waiting.getValue((*place, part))[0])
                self.waiting.removeKey((*place, part))
                over = rows["due"] <= now
                if over.any():
                    yield rows[over]
                self._wait(rows[~over], now)
            self.parts.removeKey(place)

    def close(self) -> None:
        pass


def stream_expired_apps(status: DataFrame, lateness: str = "10 minutes",
                        salts: int = SALTS) -> DataFrame:
    """Each status record once its application's time-to-live after its end has passed.

    The stream form of ``expired_apps``: a record comes out when the watermark, the latest ``ts`` less
    ``lateness``, reaches ``expired_at``, whether or not anything of its application arrives then.
    """
    ended = F.try_to_timestamp(F.col("termination_time"))
    due = F.unix_millis(ended + seconds(F.col("ttl_seconds")))
    rows = (status.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
            .select("ts", F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"), "namespace", "app",
                    "event_id", F.col("ttl_seconds").cast("long").alias("ttl_seconds"),
                    due.alias("due")))
    # Records that never expire take no state, but move the watermark on: a condition without the event
    # time in it would be moved before the watermark.
    expires = F.when(F.col("ts").isNotNull(), F.col("due")).isNotNull()
    out = (rows.where(expires).groupBy("salt")
           .transformWithStateInPandas(
               _Due(), "namespace string, app string, event_id long, ttl_seconds long, due long",
               "Append", "EventTime"))
    return out.withColumn("expired_at", F.timestamp_millis("due")).drop("due")


class _Slots(StatefulProcessor):
    """Walks along the grids of a share of schedules and gives the slots in which nothing started."""

    KINDS = {"schedule_id": "int64", "slot": "int64"}

    def __init__(self, begin: int, until: int):
        self.begin, self.until = begin, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grids = handle.getValueState("grids", "rows binary")
        self.n_parts = handle.getValueState("n_parts", "n int")
        self.started = handle.getMapState("started", "part int", "rows binary")

    def _wait(self, grids: pd.DataFrame) -> None:
        """A timer for the first end of a slot."""
        starts = self.begin + grids["next"] * grids["every"]
        open_ = starts < self.until
        if open_.any():
            self.handle.registerTimer(int((starts + grids["every"])[open_].min()) * 1000)

    def _keep(self, pairs: pd.DataFrame, n: int) -> None:
        """Add slots in which runs started, as parts from number ``n`` on."""
        for part in cut(pairs):
            self.started.updateValue((n,), (pack(part),))
            n += 1
        self.n_parts.update((n,))

    def _take(self) -> pd.DataFrame:
        """All slots that are kept, each once, out of the state."""
        n = self.n_parts.get()[0] if self.n_parts.exists() else 0
        parts = [unpack(self.started.getValue((part,))[0]) for part in range(n)]
        for part in range(n):
            self.started.removeKey((part,))
        self.n_parts.update((0,))
        empty = frame([], self.KINDS)
        return pd.concat([empty, *parts], ignore_index=True).drop_duplicates()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        grids = pd.DataFrame({"schedule_id": initialState["schedule_id"].astype("int64"),
                              "every": initialState["every_seconds"].astype("int64"), "next": 0})
        if self.grids.exists():  # a large share comes in several pieces
            grids = pd.concat([unpack(self.grids.get()[0]), grids], ignore_index=True)
        grids = grids.sort_values("schedule_id", ignore_index=True)
        self.grids.update((pack(grids),))
        self._wait(grids)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.grids.exists():
            first = unpack(self.grids.get()[0]).set_index("schedule_id")["next"]
            n = self.n_parts.get()[0] if self.n_parts.exists() else 0
            pairs = pd.concat([batch[list(self.KINDS)].drop_duplicates() for batch in rows]).drop_duplicates()
            # Rows of unknown schedules compare as false.
            pairs = pairs[pairs["slot"].to_numpy() >= first.reindex(pairs["schedule_id"]).to_numpy()]
            if n >= MOST_PARTS and len(pairs):
                pairs, n = pd.concat([self._take(), pairs]).drop_duplicates(), 0
            if len(pairs):
                self._keep(pairs, n)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        grids = unpack(self.grids.get()[0])
        now = timerValues.getCurrentWatermarkInMs() // 1000
        # All slots that are over by now, not one a timer: the watermark may have gone far.
        ids, every, first = (grids[name].to_numpy() for name in ("schedule_id", "every", "next"))
        slots = -(-(self.until - self.begin) // every)
        after = np.maximum(np.minimum((now - self.begin) // every, slots), first)
        if not (after > first).any():  # another timer has dealt with them
            return
        pairs = self._take()
        at = np.searchsorted(ids, pairs["schedule_id"].to_numpy())
        slot = pairs["slot"].to_numpy()
        over = slot < after[at]
        # Slots that are over, of all schedules in one row: where those of a schedule end, and which had runs.
        ends = np.cumsum(after - first)
        before = ends - (after - first)
        seen = np.sort((before[at] + slot - first[at])[over])
        for low in range(0, int(ends[-1]), ROWS_AT_ONCE):
            places = np.arange(low, min(low + ROWS_AT_ONCE, int(ends[-1])))
            some = slice(*np.searchsorted(seen, [low, low + ROWS_AT_ONCE]))
            places = places[~np.isin(places, seen[some])]
            if len(places):
                whose = np.searchsorted(ends, places, side="right")
                yield pd.DataFrame({"schedule_id": ids[whose],
                                    "slot": first[whose] + places - before[whose]})
        self._keep(pairs[~over], 0)
        grids["next"] = after
        self.grids.update((pack(grids),))
        self._wait(grids)

    def close(self) -> None:
        pass


def stream_missed_slots(schedules: DataFrame, runs: DataFrame, t0: str, t1: str,
                        lateness: str = "10 minutes") -> DataFrame:
    """Slots of each schedule's grid in [t0, t1) in which no run started, as the watermark passes them.

    The stream form of ``missed_slots``. Schedules are the state that the stream begins with, so one
    without any run has its timers too. ``runs`` is a stream of schedule_id and start; wall-clock times
    are taken in the session's time zone, which a stream session has as UTC.
    """
    kind = runs.schema["start"].dataType
    spark = runs.sparkSession
    begin, until = spark.range(1).select(to_epoch(F.lit(t0).cast(kind), kind),
                                         to_epoch(F.lit(t1).cast(kind), kind)).first()
    every = F.col("every_seconds").cast("long")
    active = (schedules.where(~F.coalesce("suspend", F.lit(False)) & (every > 0))
              .select(F.col("schedule_id").cast("long").alias("schedule_id"),
                      every.alias("every_seconds")))
    timed = (runs.select(F.col("schedule_id").cast("long").alias("schedule_id"),
                         F.col("start").cast("timestamp").alias("ts")).withWatermark("ts", lateness))
    # By the event time itself, so that runs outside the grid still move the watermark on.
    at = F.unix_seconds("ts")
    slot = F.floor((at - begin) / every)
    share = F.pmod(F.xxhash64("schedule_id"), F.lit(SCHEDULE_SHARES))
    started = (timed.where((at >= begin) & (at < until))
               .join(active, "schedule_id")
               .select("ts", share.alias("share"), "schedule_id", slot.alias("slot")))
    first = (active.where("schedule_id IS NOT NULL").dropDuplicates(["schedule_id"])
             .withColumn("share", share))
    out = started.groupBy("share").transformWithStateInPandas(
        _Slots(begin, until), "schedule_id long, slot long", "Append", "EventTime",
        initialState=first.groupBy("share"))
    starts = F.lit(t0).cast(kind) + seconds(F.col("slot") * F.col("every_seconds"))
    return out.join(active, "schedule_id").select("schedule_id", "slot", starts.alias("slot_start"))


class _FirstSeen(StatefulProcessor):
    """Lets a key through unless it was let through less than the time-to-live ago."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "known boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = [v for v in batch["value"].unique().tolist() if not self.seen.containsKey((v,))]
            for value in new:
                self.seen.updateValue((value,), (True,))
            if new:
                yield frame([(key[0], value) for value in new], {"key": "object", "value": "object"})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, key: str, value: str, ttl_seconds: int) -> DataFrame:
    """Each value of a key when it is met first, and again only after ``ttl_seconds`` of clock time.

    Keys and values are texts in the result; rows without either take no part. The state forgets a
    value by itself, so it holds what was met within that time, however long the stream runs.
    """
    rows = local_distinct(events.select(F.col(key).cast("string").alias("key"),
                                        F.col(value).cast("string").alias("value"))
                          .where("key IS NOT NULL AND value IS NOT NULL"))
    return rows.groupBy("key").transformWithStateInPandas(
        _FirstSeen(ttl_seconds * 1000), "key string, value string", "Append", "ProcessingTime")
