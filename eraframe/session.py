"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A film with very many fact rows is split over several join tasks, also
    # where the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles start out fine and are merged to size, so that one of many terabytes
    # does not end up in a few hundred tasks. ``spark.sql.shuffle.partitions`` holds
    # where this is unset.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_session(master: str | None = None, app: str = "eraframe", **extra: str) -> SparkSession:
    """Session with :data:`SETTINGS`; leave ``master`` out on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks that a shuffle starts out with in this session."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or usual)
