"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "inkgauge", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs rely on; cluster settings are left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture costs several driver round trips per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Pages are wide rows: small Arrow batches keep a Python worker's memory flat.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("INKGAUGE_DRIVER_MEMORY", "8g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine, one per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="inkgauge-")
    return _LOCAL_DIRS[context.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless one is already set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Pages that a Python worker is handed at once.
PAGES_PER_BATCH = 256


@contextmanager
def small_batches(spark: SparkSession, rows: int = PAGES_PER_BATCH) -> Iterator[None]:
    """Jobs that run inside hand pages to Python in small batches, so a worker's memory does not depend on how many
    pages a task has; a smaller setting of the session holds."""
    before = spark.conf.get(_BATCH_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
