"""Rules that turn exporter lines into metric names, types and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["app_namespace", "app_id", "query_name", "executor_id"]


@dataclass(frozen=True)
class MetricRule:
    """``name`` may use ``$n`` for the n-th group; ``labels`` maps a label to its group number.

    ``literals`` are texts that every matching line holds: cheap tests before the pattern.
    """

    pattern: str
    name: str
    type: str
    literals: tuple[str, ...]
    query_group: int | None = None
    executor_group: int | None = None

    def labels(self) -> dict[str, int]:
        groups = {"app_namespace": 1, "app_id": 2, "query_name": self.query_group,
                  "executor_id": self.executor_group}
        return {label: group for label, group in groups.items() if group}


# Patterns, names and types that exported metrics must match. The first rule that
# matches wins; a line that matches none is dropped.
DEFAULT_RULES = [
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.(\S+)\.StreamingMetrics\.streaming\.(\S+)><>Value",
               "spark_streaming_driver_$4", "UNTYPED",
               (".StreamingMetrics.streaming.", "><>Value")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.spark\.streaming\.(\S+)\.(\S+)><>Value",
               "spark_structured_streaming_driver_$4", "UNTYPED",
               (".driver.spark.streaming.", "><>Value"),
               query_group=3),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.(\S+)\.executor\.(\S+)><>Value",
               "spark_executor_$4", "GAUGE", (".executor.", "><>Value"), executor_group=3),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.(BlockManager|DAGScheduler|jvm)\.(\S+)><>Value",
               "spark_driver_$3_$4", "GAUGE", (".driver.", "><>Value")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.DAGScheduler\.(.*)><>Count",
               "spark_driver_DAGScheduler_$3_count", "COUNTER",
               (".driver.DAGScheduler.", "><>Count")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.HiveExternalCatalog\.(.*)><>Count",
               "spark_driver_HiveExternalCatalog_$3_count", "COUNTER",
               (".driver.HiveExternalCatalog.", "><>Count")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.CodeGenerator\.(.*)><>Count",
               "spark_driver_CodeGenerator_$3_count", "COUNTER",
               (".driver.CodeGenerator.", "><>Count")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.LiveListenerBus\.(.*)><>Count",
               "spark_driver_LiveListenerBus_$3_count", "COUNTER",
               (".driver.LiveListenerBus.", "><>Count")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.driver\.LiveListenerBus\.(.*)><>Value",
               "spark_driver_LiveListenerBus_$3", "GAUGE",
               (".driver.LiveListenerBus.", "><>Value")),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.(.*)\.executor\.(.*)><>Count",
               "spark_executor_$4_count", "COUNTER", (".executor.", "><>Count"), executor_group=3),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.([0-9]+)\.(jvm|NettyBlockTransfer)\.(.*)><>Value",
               "spark_executor_$4_$5", "GAUGE", ("><>Value",), executor_group=3),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.([0-9]+)\.HiveExternalCatalog\.(.*)><>Count",
               "spark_executor_HiveExternalCatalog_$4_count", "COUNTER",
               (".HiveExternalCatalog.", "><>Count"), executor_group=3),
    MetricRule(r"metrics<name=(\S+)\.(\S+)\.([0-9]+)\.CodeGenerator\.(.*)><>Count",
               "spark_executor_CodeGenerator_$4_count", "COUNTER", (".CodeGenerator.", "><>Count"),
               executor_group=3),
]

# Never part of an exporter line.
SEPARATOR = "\u0001"


def clean_name(name: Column, lowercase: bool = True) -> Column:
    """A legal metric name: runs of other characters, underscores included, become one ``_``."""
    legal = F.regexp_replace(name, "[^a-zA-Z0-9:]+", "_")
    return F.lower(legal) if lowercase else legal


def first_match(line: Column, rules: Sequence[MetricRule]) -> Column:
    """Name, type and label texts of the first rule that matches, separated; NULL if none does.

    A rule costs substring tests and, where they hold, one replacement that lays all texts out at
    once. A text without separator means that the pattern was not found. The filter over an array
    of one is there to look at that text without working it out again.
    """
    texts = []
    for rule in rules:
        labels = rule.labels()
        template = SEPARATOR.join([rule.name, rule.type, *[
            f"${labels[name]}" if name in labels else "" for name in LABELS]])
        laid_out = F.regexp_replace(line, f"^.*?{rule.pattern}.*$", template)
        found = F.filter(F.array(laid_out), lambda text: text.contains(SEPARATOR))
        possible = reduce(and_, [line.contains(literal) for literal in rule.literals])
        texts.append(F.when(possible, F.get(found, F.lit(0))))
    return F.coalesce(*texts)


def read_match(fields: Column, lowercase: bool = True) -> dict[str, Column]:
    """The columns in the split text of ``first_match``; a label without text is NULL."""
    columns = {"metric": clean_name(fields[0], lowercase), "type": fields[1]}
    for place, name in enumerate(LABELS, start=2):
        columns[name] = F.when(fields[place] != "", fields[place])
    return columns
