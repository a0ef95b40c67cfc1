"""Session settings for this workload."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Window chains do much work per byte, so partitions stay smaller than for scans: adaptive execution
# may merge them only up to this size, and a skewed join partition is split above it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the call site of every column function makes long plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(name: str = "playseq", **settings: str) -> SparkSession.Builder:
    """A session builder with the settings above; more can be given, dots written as two underscores.

    The cluster sets the master, executor sizes and ``spark.checkpoint.dir``.
    """
    b = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    for key, value in settings.items():
        b = b.config(key.replace("__", "."), value)
    return b
