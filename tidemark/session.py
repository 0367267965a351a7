"""The session settings that the operators' results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for every timestamp, ANSI errors instead of silent nulls, and run-time plans for skew and small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # partition columns stay text: months keep their zero, and "unknown" may stand beside them
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def session(app: str = "tidemark", master: str | None = None, **more: str) -> SparkSession:
    """A session with these settings; ``more`` are further ones, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
