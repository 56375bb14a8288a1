"""Time arithmetic that gives the same answer in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_epoch(value: Column, kind: T.DataType) -> Column:
    """Seconds since 1970, rounded down, for a value of type ``kind``.

    Wall-clock times (``timestamp_ntz``) are read off field by field, so that no session time zone
    with its skipped hours comes in.
    """
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86400 + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    return F.unix_seconds(value.cast("timestamp"))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """``to_epoch`` of a column; the order of the values follows the order of the column."""
    return to_epoch(F.col(name), df.schema[name].dataType)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column, whatever the session's time zone."""
    value, kind = F.col(name), df.schema[name].dataType
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    # SECOND holds the fraction too.
    parts = F.extract(F.lit("SECOND"), value) * 1_000_000
    return (to_epoch(value, kind) - F.second(value)) * 1_000_000 + parts.cast("long")


def packed_order(df: DataFrame, ts: str, tiebreak: str) -> Column:
    """One number that orders like (ts, tiebreak), missing values first.

    A number fits the buffer of a hash aggregate; a maximum by a struct makes Spark sort its input.
    ``tiebreak`` is a whole number; every step of the time is wider than all of them.
    """
    time = F.coalesce(epoch_micros(df, ts), F.lit(-10**17)).cast("decimal(18,0)")
    tie = F.coalesce(F.col(tiebreak).cast("long"), F.lit(-2**63)).cast("decimal(20,0)")
    return (time * F.lit("20000000000000000000").cast("decimal(20,0)") + tie).cast("decimal(38,0)")


def seconds(n: Column) -> Column:
    """An interval of ``n`` seconds, fractions included."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


# Names for fixed intervals, in seconds.
NAMED_INTERVALS = {
    "@hourly": 3600,
    "@daily": 86400,
    "@midnight": 86400,
    "@weekly": 604800,
}


def every_seconds(schedule: Column) -> Column:
    """The interval of ``@every 1h30m`` and of named intervals; NULL for calendar schedules."""
    text = F.trim(schedule)

    def part(unit: str, size: int) -> Column:
        digits = F.regexp_extract(text, rf"(\d+){unit}(?![a-z])", 1)
        return F.coalesce(F.when(digits != "", digits.cast("long")), F.lit(0)) * size

    given = part("h", 3600) + part("m", 60) + part("s", 1)
    out = F.when(text.rlike(r"^@every\s+(\d+h)?(\d+m)?(\d+s)?$") & (given > 0), given)
    for name, size in NAMED_INTERVALS.items():
        out = out.when(text == name, F.lit(size).cast("long"))
    return out
