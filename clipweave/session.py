"""Session defaults for jobs started by this package."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on for speed, never for correctness.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "clipweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session.  Pass cluster-specific settings as ``conf``.

    ``spark.sql.shuffle.partitions`` is left to the cluster: adaptive execution
    merges small partitions, so it should be set high (a few times the cores).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for cut lineage: the one in use, else ``spark.checkpoint.dir``.

    Only a local master may go without: its executors share the scratch folder made here.
    Any other master must name a folder that all executors see.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()
