"""The memory model over the driver's tables.

A memory unit is a document with its embedding and label; fields that the tables lack are derived
from the id by fixed rules, the same in MEMORY_SQL, so that every predicate has rows on either
side. `NOW` is always an argument of the operators, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-06-01 00:00:00"

# The model's enumerations.
SCOPES = ("session", "user", "team", "global")
TIERS = ("ephemeral", "working", "durable")
CATEGORIES = {"en": "events", "fr": "entities", "de": "cases", "es": "preferences"}
ROLES = (
    "current_status", "recent_work", "session_handoff", "debugging_active", "planning_active", "architecture_reference",
    "research_context", "deploy_ops", "admin_process", "operational_noise", "project_state",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory_units(spark: SparkSession, sf_dir: str, joined: tuple[str, ...] = ("embeddings", "labels")) -> DataFrame:
    """memory_unit rows. A left join can't be pruned unless its keys are known to be unique: a query that needs no
    vector leaves out `embeddings`, one that needs no confidence, quality or toxicity leaves out `labels`, and
    then has no shuffle for them."""
    doc = table(spark, sf_dir, "documents")
    if "embeddings" in joined:
        doc = doc.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), "doc_id", "left")
    if "labels" in joined:
        doc = doc.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    i = F.col("doc_id")
    hours = lambda n: F.make_dt_interval(hours=n.cast("int"))
    created = F.to_timestamp(F.lit(NOW)) - hours(i * 7 % 2400)
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    category = F.lit("profile")
    for lang, name in CATEGORIES.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    columns = [
        i.alias("id"), "text", F.lower("text").alias("text_norm"), F.col("source").alias("user_id"), category.alias("category"),
        pick(TIERS, i).alias("tier"), pick(SCOPES, i / 3).alias("scope"), F.concat(F.lit("s"), (i % 20).cast("string")).alias("session_id"),
        pick(ROLES, i / 2).alias("memory_role"), F.when(i % 4 != 0, F.concat(F.lit("/repo/"), (i % 3).cast("string"))).alias("path"),
        F.when(i % 10 == 0, False).when(i % 10 != 1, True).alias("active"),
        created.alias("created_at"), F.when(i % 5 == 0, created + hours(i % 50)).alias("last_accessed_at"), F.when(i % 9 == 0, created + hours(i % 700)).alias("invalid_at"),
        (i % 7).cast("int").alias("access_count"), (i % 50 == 0).alias("pinned"), "lang",
    ]
    if "embeddings" in joined:
        columns += ["embedding"]
    if "labels" in joined:
        columns += [F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.55).alias("confidence"), "quality", "toxic"]
    return doc.select(*columns)


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


#: The same rows for DuckDB, as a common table expression named mem.
MEMORY_SQL = f"""mem AS (
  SELECT d.doc_id AS id, d.text, lower(d.text) AS text_norm, d.source AS user_id,
    CASE d.lang WHEN 'en' THEN 'events' WHEN 'fr' THEN 'entities' WHEN 'de' THEN 'cases' WHEN 'es' THEN 'preferences' ELSE 'profile' END AS category,
    {_pick(TIERS, 'd.doc_id')} AS tier, {_pick(SCOPES, 'd.doc_id // 3')} AS scope, 's' || (d.doc_id % 20) AS session_id,
    {_pick(ROLES, 'd.doc_id // 2')} AS memory_role, CASE WHEN d.doc_id % 4 <> 0 THEN '/repo/' || (d.doc_id % 3) END AS path,
    CASE l.quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.55::DOUBLE END AS confidence,
    CASE d.doc_id % 10 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS active,
    TIMESTAMP '{NOW}' - to_hours((d.doc_id * 7 % 2400)::INTEGER) AS created_at,
    CASE WHEN d.doc_id % 5 = 0 THEN TIMESTAMP '{NOW}' - to_hours((d.doc_id * 7 % 2400)::INTEGER) + to_hours((d.doc_id % 50)::INTEGER) END AS last_accessed_at,
    CASE WHEN d.doc_id % 9 = 0 THEN TIMESTAMP '{NOW}' - to_hours((d.doc_id * 7 % 2400)::INTEGER) + to_hours((d.doc_id % 700)::INTEGER) END AS invalid_at,
    (d.doc_id % 7)::INTEGER AS access_count, d.doc_id % 50 = 0 AS pinned, e.embedding::DOUBLE[] AS embedding, d.lang, l.quality, l.toxic
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
