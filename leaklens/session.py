"""Session construction and the shared checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a
shared file system path named by the cluster).  Only when the session has
none - local tests, the bench - do we set one ourselves.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "leaklens") -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, with its scheme.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a
    private folder is made on a ``local`` master only: on a cluster every
    machine would write to its own disk, so that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="leaklens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one job's tables."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Remove a job's own sub-folders (``scratch_path``) that nothing reads any more."""
    for path in paths:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path if path.startswith("file:") else path)
        else:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of every query at its end; Spark keeps them
    until the driver's memory is collected, so those of many jobs add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# Rows and bytes that go to a Python worker at once; Spark's own 10,000 rows and
# 64 MB are held by the executor and, decoded, by the worker for every task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000,
         "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH``, unless the session has smaller ones."""
    for name, most in BATCH.items():
        now = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())
        size = int(now[1]) * _UNITS[now[2]] if now else 0
        if not 0 < size <= most:        # 0 or less: no bound
            spark.conf.set(name, str(most))


# Settings for a large cluster (100 TB of input, ~1000 executors).  The
# session there is built by the platform; ``apply_cluster_conf`` sets only
# the SQL options the session does not set itself.
CLUSTER_CONF = {
    # AQE: start with many shuffle partitions and let AQE coalesce them to
    # ~256 MB each, so no reduce task spills and no task is tiny.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.shuffle.partitions": "40000",
    # skewed join keys (a plugin with a third of all rows) are split at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    # scan splits: large enough for few tasks per file, small enough to fit memory
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    # broadcast only sides AQE has measured under 64 MB
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    # parquet: vectorised reads, nested-column pruning, pushdown
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Set ``CLUSTER_CONF`` options the session leaves unset; return what was set."""
    wanted = dict(CLUSTER_CONF, **(overrides or {}))
    applied = {}
    for k, v in wanted.items():
        current = spark.conf.get(k, None)
        if current is None or k in (overrides or {}):
            spark.conf.set(k, v)
            applied[k] = v
    return applied
