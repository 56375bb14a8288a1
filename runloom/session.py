"""Sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings this package is tested with. A cluster's own values for memory, cores and shuffle
# partitions are left alone; AQE coalesces and splits shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}

# Stateful streams keep their state on disk with a bounded memory share, not on the heap.
STREAM_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with this package's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName("runloom")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def open_session(spark: SparkSession, conf: dict[str, str] | None = None) -> SparkSession:
    """One more user session on the running application.

    Tables and cached data are shared with ``spark``; temporary views and settings are the new
    session's own. It starts with the settings of ``spark`` and then takes over ``conf``.
    """
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if child.conf.isModifiable(key):
            child.conf.set(key, value)
    for key, value in (conf or {}).items():
        child.conf.set(key, value)
    return child


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for stateful streams: UTC event times and state kept in RocksDB.

    A stream's number of state partitions is fixed by its first run: the caller's
    ``spark.sql.shuffle.partitions`` on a cluster, the number of threads in local mode.
    """
    conf = dict(STREAM_CONF)
    if spark.sparkContext.master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    return open_session(spark, conf)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    In local mode, where a machine-local folder is reachable, one is made if none is named.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="runloom-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/runloom/{name}-{uuid.uuid4().hex}"
