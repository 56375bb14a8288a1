"""Object storage, JDBC and additional catalogs."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ObjectStore:
    """An S3-compatible store. TLS is on when ``tls`` names a secret, even an empty one."""

    host: str | None = None
    port: int | None = None
    access_style: str | None = None
    tls: str | None = None

    def endpoint(self) -> str:
        if not self.host:
            raise ValueError("an object store needs a host")
        scheme = "http" if self.tls is None else "https"
        return f"{scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    def conf(self) -> dict[str, str]:
        """Settings for the session builder, or for ``spark-submit --conf``."""
        return {
            "spark.hadoop.fs.s3a.endpoint": self.endpoint(),
            "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
            "spark.hadoop.fs.s3a.path.style.access": str(self.access_style == "Path").lower(),
        }


@dataclass(frozen=True)
class Catalog:
    """One more named catalog: its class, its own options, and free settings that win."""

    name: str
    impl_class: str
    options: dict[str, str] = field(default_factory=dict)
    conf_overrides: dict[str, str] = field(default_factory=dict)

    def conf(self) -> dict[str, str]:
        if not self.impl_class:
            raise ValueError(f"catalog {self.name} has no implementation class")
        prefix = f"spark.sql.catalog.{self.name}"
        return {prefix: self.impl_class,
                **{f"{prefix}.{key}": value for key, value in self.options.items()},
                **self.conf_overrides}

    def register(self, spark: SparkSession) -> None:
        """Make the catalog known to a running session; takes effect at its first use."""
        for key, value in self.conf().items():
            spark.conf.set(key, value)


def use_namespace(spark: SparkSession, namespace: str, create: bool = False) -> None:
    """Switch to ``catalog.database`` (or a database of the current catalog)."""
    if create:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")
    spark.sql(f"USE {namespace}")


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """Copy between catalogs; both are full names. The target is replaced.

    The copy is written beside the target, which is only dropped when the copy is whole: a missing
    source, a failed write or a copy onto itself leaves the target as it was. The renaming happens
    inside the target's namespace.
    """
    rows = spark.table(source)  # raises here if there is no such table
    wanted = _full_name(spark, target)
    if [p.lower() for p in _full_name(spark, source)] == [p.lower() for p in wanted]:
        raise ValueError(f"{source} cannot be copied onto itself")
    catalog, *namespace, name = wanted
    beside = [catalog, *namespace, f"{name}_{uuid.uuid4().hex[:12]}"]
    try:
        rows.writeTo(_quoted(beside)).create()
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(wanted)}")
        # The new name is one of the same catalog.
        spark.sql(f"ALTER TABLE {_quoted(beside)} RENAME TO {_quoted([*namespace, name])}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(beside)}")
        raise


def _full_name(spark: SparkSession, name: str) -> list[str]:
    """Catalog, namespace and table, the current ones filled in, without quotes."""
    parts = [p.replace("`", "") for p in re.findall(r"`[^`]*`|[^.`]+", name)]
    if len(parts) == 1:
        parts.insert(0, spark.catalog.currentDatabase())
    if len(parts) == 2:
        parts.insert(0, spark.catalog.currentCatalog())
    return parts


def _quoted(parts: list[str]) -> str:
    return ".".join(f"`{p}`" for p in parts)


def jdbc_options(url: str, table: str, driver: str, partition_col: str | None = None,
                 lower: int | str | None = None, upper: int | str | None = None,
                 partitions: int | None = None, fetch_size: int = 10_000,
                 **options: str) -> dict[str, str]:
    """Reader options for a database table, read in parallel when a column and its range are given.

    The range only sets the stride: rows outside it are read too, by the first and last task.
    """
    out = {"url": url, "dbtable": table, "driver": driver, "fetchsize": str(fetch_size), **options}
    if partition_col:
        if None in (lower, upper, partitions):
            raise ValueError("a partitioned read needs lower, upper and partitions")
        out |= {"partitionColumn": partition_col, "lowerBound": str(lower),
                "upperBound": str(upper), "numPartitions": str(partitions)}
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str, **options) -> DataFrame:
    """A database table; see ``jdbc_options``. Filters and column choice reach the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, driver, **options)).load()
