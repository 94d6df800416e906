"""Session settings for a cluster; sizes that depend on the data are left to adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes the reduce side, splits skewed joins and re-plans from measured sizes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "evenspan", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
