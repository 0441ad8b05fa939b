"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# For local sessions only (tests, bench); on a cluster all of this is the job's own configuration.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # A third of all rows can sit on one key: keep per-task sizes bounded.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "chorus", **conf: str) -> SparkSession:
    """Return the active session, or build one.

    Without a master (here or in CHORUS_MASTER) the session is what spark-submit configured, and
    nothing is set over it. A local master gets local defaults.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("CHORUS_MASTER")
    if master:
        builder = builder.master(master)
    defaults = _LOCAL_DEFAULTS if (master or "").startswith("local") else {}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it, and it is an error if it does not: executors do not share a folder of one
    machine. Only a local session makes its own, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="chorus-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never reused, never cleared)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/chorus-{name}-{uuid.uuid4().hex[:12]}"
