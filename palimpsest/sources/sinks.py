"""Sinks: keyed upsert, append of new keys, Markdown vault and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lifecycle import merge
from palimpsest.operators.shaping import redacted


def upsert(current: DataFrame, incoming: DataFrame, key: str, path: str) -> None:
    """The merged table, written as a new version: rows without text are refused, text_norm is derived. A
    table can't be overwritten while it is read, so each version has its own path."""
    fresh = incoming.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text_norm", F.lower(F.trim("text")))
    merge(current, fresh, key).write.mode("errorifexists").parquet(path)


def append_new(current: DataFrame, incoming: DataFrame, keys: list[str], path: str) -> None:
    """Rows whose key is new; a key that is there already is a no-op."""
    incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def vault(memories: DataFrame) -> DataFrame:
    """(folder, day, note): Markdown notes for `df.write.partitionBy("folder", "day").text(path)`."""
    title = F.substring(F.regexp_replace("text", r"[\r\n]+", " "), 1, 60)
    note = F.concat(F.lit("## "), redacted(title), F.lit("\n\n"), redacted(F.col("text")), F.lit("\n\n- id: "), F.col("id").cast("string"), F.lit("\n- tier: "), F.col("tier"))
    return memories.where(F.coalesce("active", F.lit(True))).select(F.col("category").alias("folder"), F.to_date("created_at").alias("day"), note.alias("note"))


def report(gaps: DataFrame, limit: int = 50) -> DataFrame:
    """(line): a Markdown table of the highest scores, its rows ordered."""
    rows = gaps.orderBy(F.desc("score"), "fingerprint").limit(limit)
    line = F.concat_ws(" | ", F.lit(""), F.col("kind"), redacted(F.substring("item", 1, 80)), F.col("n").cast("string"), F.round("score", 2).cast("string"), F.lit(""))
    return rows.select(F.trim(line).alias("line"))
