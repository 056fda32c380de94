"""Spark session settings and the shared checkpoint folder.

The settings are the ones every job in the package assumes: AQE on (runtime
broadcast conversion, partition coalescing, skew-join splitting), the session
time zone pinned to UTC (sale dates are wall-clock values), and no web UI.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the iterative jobs run hundreds of small jobs: keep less status history
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "400",
    "spark.ui.retainedTasks": "20000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_spark(master: str | None = None, app: str = "stockbook",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only for local runs.

    On a cluster the folder is named by ``spark.checkpoint.dir`` and must be
    on shared storage; it is read from the session and never replaced. Only a
    ``local[...]`` master (tests, laptop) gets a scratch folder when unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "before running jobs that cut lineage")
    scratch = tempfile.mkdtemp(prefix="stockbook-ckpt-",
                               dir=os.environ.get("STOCKBOOK_SCRATCH", None))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()
