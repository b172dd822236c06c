"""A session with the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "palimpsest", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if master:
        b = b.master(master)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
