"""Names and owners of resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Owner kinds, first match wins. Any other kind is "Other".
OWNER_KINDS = ["SparkJob", "SparkSession", "SparkScheduledJob"]


def repair_name(name: Column) -> Column:
    """A resource name without dots."""
    return F.replace(name, F.lit("."), F.lit("-"))


def owner_class(owners: Column) -> Column:
    """The class of an owner list; NULL when there is no list at all."""
    kinds = F.transform(owners, lambda owner: owner["kind"])
    out = F.when(owners.isNull(), F.lit(None).cast("string"))
    for kind in OWNER_KINDS:
        out = out.when(F.array_contains(kinds, kind), F.lit(kind))
    return out.otherwise(F.lit("Other"))
