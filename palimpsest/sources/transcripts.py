"""Transcript files: JSON lines of client records, read permissively and flattened to turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "type string, uuid string, timestamp timestamp, sessionId string, cwd string, version string, gitBranch string, "
    "message struct<role: string, content: string>, _corrupt_record string"
)
BLOCKS = "array<struct<type: string, text: string, thinking: string, name: string, content: string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """All lines; those that aren't JSON have their text in _corrupt_record."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def turns(records: DataFrame) -> DataFrame:
    """(session_id, uuid, ts, role, text) of user and assistant messages: plain strings, or the text blocks of
    an array; tool use, thinking and empty content yield no turn; injected memories are cut out."""
    content = F.col("message.content")
    blocks = F.from_json(content, BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "")), lambda b: b["text"])
    flat = F.when(F.startswith(F.ltrim(content), F.lit("[{")), F.array_join(texts, "\n")).otherwise(content)
    text = F.trim(F.regexp_replace(flat, r"(?s)<relevant-memories>.*?</relevant-memories>", ""))
    kept = records.where(F.col("type").isin("user", "assistant") & F.col("message.role").isin("user", "assistant"))
    return kept.select(F.col("sessionId").alias("session_id"), "uuid", F.col("timestamp").alias("ts"), F.col("message.role").alias("role"), text.alias("text")).where("text is not null and text <> ''")
