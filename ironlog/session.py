"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # The JVM does not compile methods above 8000 bytes of byte code.  Beyond
    # that, split per-operator code is several times faster than one fused,
    # interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Run-time join choice, partition coalescing and skew splitting.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins with small partitions on one side hash them instead of sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Dates are plain calendar days.
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
