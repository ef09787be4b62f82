"""Helpers shared by the training-data operators: reading, materialising, folds and words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the operators' contract: a run of characters other than space and tab..carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local session without one, as in tests, gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: later reads survive a lost executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables: for those that no later step reads."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.materialized_at)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def map_rows(docs: DataFrame, ids: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """docs' `ids` and `columns` through run, which maps pandas batches of them to rows of (ids.., schema). The ids,
    whole numbers, travel as text: pandas would turn them into floats where one is null."""
    sent = docs.select(*[F.col(c).cast("long").cast("string").alias(c) for c in ids], *columns)
    out = sent.mapInPandas(run, ", ".join([f"{c} string" for c in ids] + [schema]))
    return out.withColumns({c: F.col(c).cast("long") for c in ids})


def narrow(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcasting if it has no more than `limit` rows; joined by shuffling otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; rows of fold 2 are held out. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def hash_fraction(key: Column, fraction: Column | float, seed: int) -> Column:
    """True for about `fraction` of the keys, the same ones in every run."""
    share = F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return share < fraction


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: it is bound as a lambda variable, which no
    optimiser rule can expand into an expression that is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
