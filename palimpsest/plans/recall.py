"""Recall: legs, fusion, re-ranking and what wraps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vec
from palimpsest.operators import retrieval as rt
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()


def now_col() -> Column:
    return F.lit(NOW).cast("timestamp")


QUERY = "the and that with anle entar onthe passage tion language"
TERMS = tx.significant_tokens(QUERY)
TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
QVEC_SQL = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
COSINE = "(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))))"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The one stated query: the vector of row 0."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def leg_sql(name: str, scored: str, k: int) -> str:
    return f"{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM ({scored}) ORDER BY score DESC, id LIMIT {k})"


VECTOR_SQL = f"SELECT id, {COSINE.format(a='embedding', b='q')} AS score FROM mem, qv WHERE embedding IS NOT NULL"
BM25_CTES = f"""
stats AS (SELECT count(*) AS n, avg(len(string_split(text_norm, ' '))) AS avgdl FROM mem),
bag AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM mem),
hits AS (SELECT id, len(t) AS dl, unnest(list_filter(t, lambda x: list_contains({TERMS_SQL}, x))) AS term FROM bag),
counts AS (SELECT id, dl, term, count(*) AS tf FROM hits GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term)"""
BM25_SQL = "SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM counts JOIN dfs USING (term), stats GROUP BY id"
RECENCY_SQL = f"SELECT id, epoch(created_at)::DOUBLE AS score FROM mem WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND created_at <= TIMESTAMP '{NOW}'"


@R.query(f"WITH {MEMORY_SQL}, {QVEC_SQL}, {leg_sql('leg', VECTOR_SQL, 50)} SELECT id, rank, round(score, 6) AS score FROM leg")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.vector_leg(memory_units(spark, sf_dir, ("embeddings",)), query_vector(spark, sf_dir), 50).select("id", "rank", F.round("score", 6).alias("score"))


@R.query(f"WITH {MEMORY_SQL} SELECT count(*) AS n, round(avg(len(string_split(text_norm, ' '))), 6) AS avgdl FROM mem")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.corpus_stats(memory_units(spark, sf_dir, ())).select("n", F.round("avgdl", 6).alias("avgdl"))


@R.query(f"WITH {MEMORY_SQL}, {BM25_CTES}, {leg_sql('leg', BM25_SQL, 50)} SELECT id, rank, round(score, 6) AS score FROM leg")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25_leg(memory_units(spark, sf_dir, ()), TERMS, 50).select("id", "rank", F.round("score", 6).alias("score"))


@R.query(f"WITH {MEMORY_SQL}, {leg_sql('leg', f'SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), $$[\\p{{L}}\\p{{N}}_]+$$)), {TERMS_SQL})) / {len(TERMS)} AS score FROM mem WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), $$[\\p{{L}}\\p{{N}}_]+$$)), {TERMS_SQL})) > 0', 100)} SELECT id, rank, round(score, 6) AS score FROM leg")
def overlap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.overlap_leg(memory_units(spark, sf_dir, ()), TERMS, 100).select("id", "rank", F.round("score", 6).alias("score"))


@R.query(f"WITH {MEMORY_SQL}, {leg_sql('leg', RECENCY_SQL, 50)} SELECT id, rank, score FROM leg")
def recency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.recency_leg(memory_units(spark, sf_dir, ()), now_col(), 48, 50).select("id", "rank", "score")


FUSED_SQL = f"""
{leg_sql('v', VECTOR_SQL, 45)}, {BM25_CTES}, {leg_sql('b', BM25_SQL, 45)}, {leg_sql('r', RECENCY_SQL, 45)},
parts AS (SELECT id, rank, 'vector' AS leg, 1.0::DOUBLE / (60 + rank) AS part FROM v UNION ALL SELECT id, rank, 'bm25', 1.2::DOUBLE / (60 + rank) FROM b
  UNION ALL SELECT id, rank, 'recency', 0.8::DOUBLE / (60 + rank) FROM r),
fused AS (SELECT id, sum(part) AS score, max(rank) FILTER (WHERE leg = 'vector') AS vector_rank, max(rank) FILTER (WHERE leg = 'bm25') AS bm25_rank,
  max(rank) FILTER (WHERE leg = 'recency') AS recency_rank FROM parts GROUP BY id)"""


@R.query(f"WITH {MEMORY_SQL}, {QVEC_SQL}, {FUSED_SQL}, {leg_sql('best', 'SELECT id, round(score, 9) AS score FROM fused', 15)} SELECT best.id, rank, round(score, 6) AS score, text, category FROM best JOIN mem ON mem.id = best.id")
def hybrid_rrf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ("embeddings",))
    best = rt.hybrid(memories, query_vector(spark, sf_dir), TERMS, now_col(), 15)
    return rt.hydrate(memories, best, "text", "category").select("id", "rank", F.round("score", 6).alias("score"), "text", "category")


@R.query(f"WITH {MEMORY_SQL}, {QVEC_SQL}, {FUSED_SQL} SELECT id, round(score, 6) AS score, vector_rank, bm25_rank, recency_rank FROM fused")
def leg_rank_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ("embeddings",))
    legs = {"vector": rt.vector_leg(memories, query_vector(spark, sf_dir), 45), "bm25": rt.bm25_leg(memories, TERMS, 45), "recency": rt.recency_leg(memories, now_col(), 48, 45)}
    return rt.fuse(legs).withColumn("score", F.round("score", 6))


@R.query(f"""WITH {MEMORY_SQL}, {QVEC_SQL}, {FUSED_SQL}, {leg_sql('best', 'SELECT id, round(score, 9) AS score FROM fused', 15)},
s AS (SELECT id, {COSINE.format(a='embedding', b='q')} AS score FROM best JOIN mem USING (id), qv WHERE len(embedding) = 64)
SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'direct' WHEN score >= 0.5 THEN 'supporting' WHEN score >= 0.3 THEN 'background' END AS label FROM s WHERE score >= 0.3""")
def rerank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, query = memory_units(spark, sf_dir, ("embeddings",)), query_vector(spark, sf_dir)
    best = rt.hybrid(memories, query, TERMS, now_col(), 15)
    return rt.rerank(rt.hydrate(memories, best, "embedding"), query).select("id", F.round("score", 6).alias("score"), "label")


@R.query(f"""WITH {MEMORY_SQL}, {BM25_CTES}, {leg_sql('b', BM25_SQL, 50)},
x AS (SELECT b.id, score, least(1.0, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), {TERMS_SQL})) / {len(TERMS)} + 0.25 * regexp_matches(text, '\\b[0-9]+\\b')::INTEGER
  + 0.1 * (strpos(text_norm, 'passage') > 0)::INTEGER) AS exact FROM b JOIN mem ON mem.id = b.id)
SELECT id, round(exact, 6) AS exact, round(score + CASE WHEN exact >= 0.5 THEN 0.05 * exact ELSE 0.0 END, 6) AS score FROM x""")
def exact_qa_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ())
    hits = rt.hydrate(memories, rt.bm25_leg(memories, TERMS, 50), "text", "text_norm")
    bumped = rt.exact_bump(hits, TERMS, F.col("text").rlike(r"\b[0-9]+\b"), F.contains("text_norm", F.lit("passage")))
    return bumped.select("id", F.round("exact", 6).alias("exact"), F.round("score", 6).alias("score"))


CLAIMS = "claims AS (SELECT id + 1000000000 AS id, confidence AS score, [id, id + 1, id + 2] AS supports FROM mem WHERE pinned AND confidence IS NOT NULL)"


@R.query(f"""WITH {MEMORY_SQL}, {CLAIMS}, {leg_sql('r', RECENCY_SQL, 200)}
SELECT id, round(score, 6) AS score FROM claims UNION ALL SELECT id, round(score, 6) FROM r WHERE id NOT IN (SELECT unnest(supports) FROM claims)""")
def claim_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ("labels",))
    claims = memories.where("pinned and confidence is not null").select((F.col("id") + 1000000000).alias("id"), F.col("confidence").alias("score"), F.array("id", F.col("id") + 1, F.col("id") + 2).alias("supports"))
    return rt.merge_claims(rt.recency_leg(memories, now_col(), 48, 200), claims, "primary").select("id", F.round("score", 6).alias("score"))


@R.query(f"""WITH {MEMORY_SQL}, {CLAIMS}, {leg_sql('r', "SELECT id, 1.0 AS score FROM mem WHERE created_at > TIMESTAMP '2099-01-01'", 10)}
SELECT id, score FROM r UNION ALL SELECT id, round(score * 0.6, 6) FROM claims WHERE NOT EXISTS (SELECT 1 FROM r)""")
def claim_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ("labels",))
    claims = memories.where("pinned and confidence is not null").select((F.col("id") + 1000000000).alias("id"), F.col("confidence").alias("score"), F.array("id").alias("supports"))
    none = rt.recency_leg(memories, F.lit("2099-01-03").cast("timestamp"), 1, 10)
    return rt.merge_claims(none, claims, "annotation").select("id", F.round("score", 6).alias("score"))


ENTITY_SQL = """
edges AS (SELECT l_suppkey AS entity, l_partkey AS id, max(1 - l_discount * 5) AS confidence FROM lineitem GROUP BY ALL),
matches AS (SELECT s_suppkey AS entity FROM supplier WHERE s_nationkey IN (1, 2, 3)),
kept AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC NULLS LAST, id) AS k FROM edges SEMI JOIN matches USING (entity)),
scored AS (SELECT id, sum(greatest(0.1, coalesce(confidence, 0.5))) AS score FROM kept WHERE k <= 25 GROUP BY id)"""


@R.query(f"WITH {ENTITY_SQL}, s AS (SELECT id, round(score, 6) AS score FROM scored) SELECT id, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, score FROM s ORDER BY score DESC, id LIMIT 50")
def entity_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    edges = line.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("id")).agg(F.max(1 - F.col("l_discount") * 5).alias("confidence"))
    matches = table(spark, sf_dir, "supplier").where(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("entity"))
    kept = rt.top_per(edges.join(matches, "entity", "left_semi"), ["entity"], 25, F.desc_nulls_last("confidence"), F.asc("id"))
    scored = kept.groupBy("id").agg(F.round(F.sum(F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.5)))), 6).alias("score"))
    return rt.top(scored, 50).select("id", "rank", "score")


@R.query(f"WITH {MEMORY_SQL}, s AS (SELECT embedding FROM mem WHERE embedding IS NOT NULL) SELECT len(embedding) AS dim, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x * x)))), 6) AS mean_norm FROM s GROUP BY ALL")
def embedding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's dimension census: a recall whose model has another dimension must return no rows."""
    rows = memory_units(spark, sf_dir, ("embeddings",)).where(F.col("embedding").isNotNull())
    return rows.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.round(F.avg(vec.norm(F.col("embedding"))), 6).alias("mean_norm"))
