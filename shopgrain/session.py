"""Session settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Partition counts and join strategies are left to adaptive execution; shuffles
# start wide and are merged to about the advised size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app: str = "shopgrain", master: str | None = None, shuffle_partitions: int | None = None,
    more: dict[str, str] | None = None,
) -> SparkSession:
    """A session with these settings and ``more``; on a cluster the submit options name the rest."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(more or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
