"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings this library relies on; applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows that come sorted by the key are aggregated once, as they come.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "invoxa") -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    On a cluster the caller's session is reused as is: only settings that are
    unset get a default, so cluster-level tuning is never overridden.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("INVOXA_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    # Shared folder for lineage cuts: keep the cluster's setting; only a local
    # session without one gets a private scratch folder.
    master = spark.sparkContext.master
    if not checkpoint_dir(spark) and master.startswith("local") and not master.startswith("local-cluster"):
        local = tempfile.mkdtemp(prefix="invoxa-ckpt-")
        spark.conf.set("spark.checkpoint.dir", local)
        spark.sparkContext.setCheckpointDir(local)


def checkpoint_dir(spark: SparkSession) -> str | None:
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return value or None


def run_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder; no run replaces another's files."""
    base = checkpoint_dir(spark)
    if base is None:
        apply_defaults(spark)
        base = checkpoint_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used between pipeline phases (which hand files from phase to
    phase): it cuts lineage, so a lost executor recomputes from the written
    table, never from the raw page scan.

    ``by``: write it in buckets of that column, as many as the session has shuffle
    partitions, so a join on the column reads it without an exchange. Where ``df`` is
    hash-partitioned by that column already, each bucket is written by one task. The table
    stands in the session's catalog under the name of its folder.
    """
    spark, path = df.sparkSession, run_path(df.sparkSession, name)
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)
    entry = "invoxa_" + path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(entry)
    return spark.table(entry)


def _release_plans(spark: SparkSession) -> None:
    """Lets the driver's JVM collect the plans nobody refers to, with which Spark removes their
    shuffle files. The first pass often meets events of the last job that still hold its plan."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def handed_over(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a block: the table is removed at its end, so let all
    that is read later be written within the block.

    A shuffle's files stay until the driver's JVM happens to collect the plan they belong to.
    Those of ``df`` have no use once the table is written, and go before the block begins if
    the caller keeps no other reference to ``df``.
    """
    spark, path = df.sparkSession, run_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    _release_plans(spark)
    try:
        yield spark.read.parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_observed(df: DataFrame, name: str, metrics: list[Column],
                         by: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    """``materialize``, and the aggregates ``metrics`` over its rows with the ``seconds`` it took.

    They are observed while the table is written, by the job that writes it; a task that is
    run again counts once. ``seconds`` is the wall clock of the whole batch, since a
    distributed run has no time of its own for each document.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    start = time.monotonic()
    written = materialize(df.observe(seen, *metrics), name, by)
    return written, {**seen.get, "seconds": time.monotonic() - start}
