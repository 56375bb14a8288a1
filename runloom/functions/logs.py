"""The log line layout ``yy/MM/dd HH:mm:ss LEVEL Logger: message`` and its filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from low to high.
LEVELS = ["ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF"]

# The default thresholds by logger, and the text of lines that are dropped.
DEFAULT_THRESHOLDS = [
    ("org.apache.spark.repl.Main", "INFO"),
    ("org.apache.spark.sql.hive.thriftserver.SparkSQLCLIDriver", "INFO"),
    ("org.sparkproject.jetty", "WARN"),
    ("org.sparkproject.jetty.util.component.AbstractLifeCycle", "ERROR"),
    ("org.apache.spark.repl.SparkIMain$exprTyper", "INFO"),
    ("org.apache.spark.repl.SparkILoop$SparkILoopInterpreter", "INFO"),
    ("org.apache.parquet", "ERROR"),
    ("parquet", "ERROR"),
    ("org.apache.hadoop.hive.metastore.RetryingHMSHandler", "FATAL"),
    ("org.apache.hadoop.hive.ql.exec.FunctionRegistry", "ERROR"),
]
DROPPED_TEXT = "Thrift error occurred during processing of message"

# The head of a log event: time, level, logger, and the first line of the message.
HEAD = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) ([A-Z]+) ([^:]*): ?"
HEAD_TIME = "yy/MM/dd HH:mm:ss"


def is_head(line: Column) -> Column:
    """Whether a line opens a log event. Anything else continues the event before it."""
    return line.rlike(HEAD)


def split_head(line: Column) -> Column:
    """Time, level, logger and message as an array; NULL for a line that is not a head."""
    marked = F.regexp_replace(line, HEAD, "$1\u0001$2\u0001$3\u0001")
    return F.when(is_head(line), F.split(marked, "\u0001", 4))


def head_fields(parts: Column, line: Column) -> dict[str, Column]:
    """The columns in an array from ``split_head``.

    An impossible time is NULL and the rest stays; a line that is not a head is all message.
    """
    time = F.try_to_timestamp(parts[0], F.lit(HEAD_TIME)).cast("timestamp_ntz")
    return {"ts": time, "level": parts[1], "logger": parts[2],
            "message": F.coalesce(parts[3], line)}


def severity(level: Column) -> Column:
    """The rank of a level name; NULL for a name that is not a level."""
    rank = F.array_position(F.array(*[F.lit(name) for name in LEVELS]), F.upper(level))
    return F.when(rank > 0, rank)


def threshold(logger: Column, rules: Sequence[tuple[str, str]], root_level: str) -> Column:
    """The lowest level let through for ``logger``: that of its longest configured ancestor.

    The rules are a configuration file's worth of lines, so they become one expression, longest
    name first: no join, no shuffle, and the same on a stream.
    """
    out = None
    for prefix, level in sorted(rules, key=lambda rule: -len(rule[0])):
        hit = (logger == prefix) | logger.startswith(prefix + ".")
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return F.lit(root_level) if out is None else out.otherwise(F.lit(root_level))
