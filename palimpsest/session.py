"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins, splits skewed ones and sizes shuffles at run time; UTC makes dates comparable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; master only for local runs, a cluster sets its own."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
