"""Log lines: parse, filter, and put events of several lines back together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.logs import (DEFAULT_THRESHOLDS, DROPPED_TEXT, head_fields, is_head,
                                    severity, split_head, threshold)


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Split lines into ts, level, logger, message. A line without a head is all message."""
    others = [c for c in lines.columns if c != line]
    # Exploded, so that filters on the fields are not moved down to parse each line again.
    parts = F.explode(F.array(split_head(F.col(line)))).alias("_head")
    fields = head_fields(F.col("_head"), F.col(line))
    return lines.select(*others, line, parts).select(
        *others, *[value.alias(name) for name, value in fields.items()])


def filter_by_threshold(logs: DataFrame, rules: Sequence[tuple[str, str]] = DEFAULT_THRESHOLDS,
                        root_level: str = "INFO", logger: str = "logger_full") -> DataFrame:
    """Keep rows at or above the threshold of their logger.

    ``logger`` must hold full names: the text layout prints only the last segment, for which only
    the root threshold would ever apply.
    """
    lowest = threshold(F.col(logger), rules, root_level)
    return logs.where(severity(F.col("level")) >= severity(lowest))


def drop_messages(logs: DataFrame, text: str = DROPPED_TEXT) -> DataFrame:
    """Drop rows whose message holds ``text``."""
    return logs.where(~F.coalesce(F.col("message").contains(text), F.lit(False)))


def number_lines(lines: DataFrame) -> DataFrame:
    """Give every line its number in its file and the number of the line that opens its event.

    ``lines`` comes from ``read_lines``. Work is cut at file splits, so one huge file is spread over
    as many tasks as it has splits; the splits are tied together by a table with one row per split.
    Lines before the first head of a file have no opening line.
    """
    split = ["file", "block"]
    key = F.col("line_key")
    flagged = lines.withColumn("_head", is_head(F.col("line")))
    # Keys of one split follow each other without gaps, so a line's place in it needs no sort.
    totals = (flagged.groupBy(*split)
              .agg(F.count(F.lit(1)).alias("_n"),
                   (F.max(F.when(F.col("_head"), key)) - F.min(key) + 1).alias("_last")))
    earlier = (Window.partitionBy("file").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = (totals
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .withColumn("_open", F.last(F.col("_before") + F.col("_last"),
                                           ignorenulls=True).over(earlier))
               .select(*split, "_before", "_open"))
    along = Window.partitionBy(*split).orderBy(key)
    first = F.first(key).over(along)
    opened = F.last(F.when(F.col("_head"), key), ignorenulls=True).over(along)
    return (flagged.withColumns({"_place": key - first + 1, "_opened": opened - first + 1})
            .join(carried, split)
            .select("file", (F.col("_before") + F.col("_place")).alias("line_no"),
                    F.coalesce(F.col("_before") + F.col("_opened"), F.col("_open"))
                    .alias("event_line"),
                    "line"))


def assemble_log_events(lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """One row per log event: the head's fields, and all its lines as one message.

    With ``max_lines`` a longer event comes as several rows, numbered by ``part``, each with the
    head's time, level and logger; without it every event is one row, part 0, however long. Lines
    before a file's first head form an event without time, level and logger.
    """
    numbered = number_lines(lines)
    start = F.coalesce(F.col("event_line"), F.lit(1))
    part = (F.floor((F.col("line_no") - start) / F.lit(max_lines)) if max_lines
            else F.lit(0).cast("long"))
    # Only heads are parsed; an event's other lines go on as they are.
    parts = F.when(F.col("line_no") == F.col("event_line"), split_head(F.col("line")))
    numbered = numbered.select("file", F.coalesce("event_line", F.lit(0)).alias("event_line"),
                               part.alias("part"), "line_no", "line",
                               F.explode(F.array(parts)).alias("_head"))
    fields = head_fields(F.col("_head"), F.col("line"))
    pieces = numbered.select("file", "event_line", "part", "line_no",
                             *[value.alias(name) for name, value in fields.items()])
    grouped = pieces.groupBy("file", "event_line", "part").agg(
        F.max("ts").alias("ts"), F.max("level").alias("level"), F.max("logger").alias("logger"),
        F.sort_array(F.collect_list(F.struct("line_no", "message"))).alias("_lines"))
    if max_lines:
        heads = (pieces.where(F.col("line_no") == F.col("event_line"))
                 .select("file", "event_line", "ts", "level", "logger"))
        grouped = (grouped.drop("ts", "level", "logger")
                   .join(heads, ["file", "event_line"], "left"))
    return grouped.select(
        "file", "event_line", "part", "ts", "level", "logger",
        F.array_join(F.col("_lines.message"), "\n").alias("message"),
        F.size("_lines").alias("n_lines"))
