"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[8]",
    app: str = "tablewright",
    shuffle_partitions: int = 8,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster the caller brings their own session; nothing below is needed there except
    adaptive execution, which is Spark's default, and UTC.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="tablewright-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediates, in a folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local-mode session, whose executors live in
    the driver's own process, falls back to a temporary folder, removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/tablewright-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path ``name`` in the application's folder, which ``remove_intermediates`` drops as a whole."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
