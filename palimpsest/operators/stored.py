"""Tables written to the cluster's shared folder: they cut lineage, and are computed once for several readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's path inside the cluster's checkpoint folder, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Written to the cluster's checkpoint folder and read back, to cut an iteration's lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for broadcasting if it has no more than so many (narrow) rows; joined by shuffling otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
