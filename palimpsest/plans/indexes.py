"""Indexes kept in folders: a keyword index with bounds and an inverted file of vectors, each grown by an append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.keyword_index import KeywordIndex
from palimpsest.operators.retrieval import top_per
from palimpsest.operators.stored import scratch
from palimpsest.operators.vector_index import VectorIndex
from palimpsest.plans.recall import BM25_CTES, BM25_SQL, COSINE, TERMS, leg_sql
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table

R = Registry()

#: Rows created before this are built first, the others appended.
APPENDED_FROM = "2024-05-20 00:00:00"
CELLS, K = 64, 10


@R.query(f"WITH {MEMORY_SQL}, {BM25_CTES}, {leg_sql('leg', BM25_SQL, 50)} SELECT id, rank, round(score, 6) AS score FROM leg")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm25_topk from an index of all memories, built in two parts."""
    memories = memory_units(spark, sf_dir, ())
    index = KeywordIndex(spark, scratch(spark))
    later = F.col("created_at") >= F.lit(APPENDED_FROM).cast("timestamp")
    index.append(memories.where(~later))
    index.append(memories.where(later))
    found, _ = index.search(TERMS, 50)
    return found.select("id", "rank", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all embeddings, and as queries those whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, scratch(spark))
    index.train(rows, CELLS)
    index.append(rows)
    return index, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def probes(spark: SparkSession, sf_dir: str, index: VectorIndex) -> int:
    """Calibrated on a bounded sample of rows that aren't queries."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 100 <> 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.calibrated(rows, K + 1, 0.93)


def others(found: DataFrame) -> DataFrame:
    """The K best rows but the query's own."""
    kept = found.where("id <> query_id").drop("rank")
    return top_per(kept, ["query_id"], K, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@R.query(f"""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round({COSINE.format(a='q.v', b='p.v')}, 9) AS score FROM u q JOIN u p ON p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= {K}""")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest rows by cells and their bounds: exact."""
    index, queries = vector_index(spark, sf_dir)
    return others(index.search(queries, K + 1, CELLS // 8, exact=True))


@R.query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest rows in as many cells as find nine in ten of a sample's neighbours; recall is tested."""
    index, queries = vector_index(spark, sf_dir)
    return others(index.search(queries, K + 1, probes(spark, sf_dir, index)))
