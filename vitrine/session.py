"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC wall clock, ANSI arithmetic (overflow
# and bad casts raise), adaptive execution with partition coalescing and skew
# join splitting, Arrow for the few bounded results that reach the driver.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "vitrine", extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs.

    On a cluster, submit with the cluster's own master and sizing; only the
    semantic settings in ``SESSION_DEFAULTS`` are required.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, making it the context's default.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is. Only a local-mode session without the setting (tests) gets a
    fresh folder of its own; a cluster session without it is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for checkpoints")
        configured = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
