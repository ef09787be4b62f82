"""Retrieval legs and their fusion: exact cosine, BM25, recency and entity links, fused by rank.

Legs return (id, rank, score) only; whole rows are fetched for the fused top k alone, so that wide
columns are read for k rows. Every top k breaks ties by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vec
from palimpsest.operators.stored import written

# Fusion and scoring constants.
RRF_K = 60
WEIGHTS = {"vector": 1.0, "bm25": 1.2, "recency": 0.8, "entity": 0.45}
K1, B = 1.2, 0.75


def top(df: DataFrame, k: int, score: str = "score", ident: str = "id") -> DataFrame:
    """The k best rows with their rank from 1: a TakeOrdered, then a window over k rows."""
    best = df.orderBy(F.desc(score), F.asc(ident)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(ident))))


def top_per(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The k first rows of each group; a window group limit keeps only k rows a task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def vector_leg(memories: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Exact cosine over every row that has a vector."""
    scored = memories.where(F.col("embedding").isNotNull()).select("id", vec.cosine(F.col("embedding"), vec.literal(query)).alias("score"))
    return top(scored, k)


def corpus_stats(memories: DataFrame) -> DataFrame:
    """One row: n rows and their mean length in words split at single spaces (1 where there is none)."""
    return memories.agg(F.count("*").alias("n"), F.coalesce(F.avg(words("text_norm")), F.lit(1.0)).alias("avgdl"))


def words(column: str) -> Column:
    """How many words: pieces between single spaces."""
    return F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit(""))) + 1


def bm25_scores(memories: DataFrame, terms: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(id, score) of the rows that hold a term. Document frequencies count over the matched rows; lengths
    are tokens, the mean length is words: as specified, not symmetric. One scan: while it counts the terms of
    the rows that hold one, in a table of their own, it observes the number and length of all rows, unless
    stats, one row of corpus_stats, are given."""
    seen = Observation()
    watched = memories.observe(seen, F.count("*").alias("n"), F.avg(words("text_norm")).alias("avgdl")) if stats is None else memories
    counts = written(term_counts(watched, terms))
    n_with = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    known = counts.join(F.broadcast(counts.agg(*n_with)), F.lit(True))  # one row
    if stats is None:
        known = known.withColumns({"n": F.lit(seen.get["n"]), "avgdl": F.lit(seen.get["avgdl"] or 1.0)})
    else:
        known = known.join(F.broadcast(stats), F.lit(True))  # one row

    def part(i: int) -> Column:
        tf, df = F.col("tf")[i], F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return known.select("id", sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def term_counts(memories: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, dl, tf): tokens of each row that holds a term, and how often each of the terms occurs. Texts without
    any of the terms are passed by without being tokenised."""
    low = F.lower("text")
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == str(t)))
    may_match = reduce(or_, [F.contains(low, F.lit(str(t))) for t in terms])
    counted = tx.let(tx.tokens(F.col("text")), lambda bag: F.struct(F.size(bag).alias("dl"), F.array(*[count(bag, t) for t in terms]).alias("tf")))
    # exploding keeps the filter on its result from tokenising once more
    rows = memories.where(may_match).select("id", F.explode(F.array(counted)).alias("c"))
    return rows.where(F.exists("c.tf", lambda n: n > 0)).select("id", "c.dl", "c.tf")


def bm25_leg(memories: DataFrame, terms: Sequence[str], k: int, stats: DataFrame | None = None) -> DataFrame:
    return top(bm25_scores(memories, terms, stats), k)


def overlap_leg(memories: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """The keyword leg's fallback: the share of the query's terms that a row holds."""
    held = F.size(F.array_intersect(tx.tokens(F.col("text")), F.lit(list(terms))))
    return top(memories.select("id", (held / len(terms)).alias("score")).where("score > 0"), k)


def recency_leg(memories: DataFrame, now: Column, hours: int, k: int) -> DataFrame:
    """Rows created within the window, newest first: sorted, then limited."""
    recent = memories.where((F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("created_at") <= now))
    return top(recent.select("id", F.unix_seconds("created_at").cast("double").alias("score")), k)


def entity_leg(matches: DataFrame, edges: DataFrame, links: int = 25, k: int = 50) -> DataFrame:
    """matches(entity), edges(entity, id, confidence): at most `links` edges an entity, scores summed per row."""
    kept = top_per(edges.join(matches, "entity", "left_semi"), ["entity"], links, F.desc_nulls_last("confidence"), F.asc("id"))
    scored = kept.groupBy("id").agg(F.sum(F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.5)))).alias("score"))
    return top(scored, k)


def fuse(legs: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: (id, score) and each leg's rank. One union and one aggregation
    instead of outer joins."""
    weights = WEIGHTS | (weights or {})
    parts = [leg.select("id", "rank", F.lit(name).alias("leg"), (F.lit(float(weights[name])) / (RRF_K + F.col("rank"))).alias("part")) for name, leg in legs.items()]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    ranks = [F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs]
    return together.groupBy("id").agg(F.sum("part").alias("score"), *ranks)


def hydrate(memories: DataFrame, best: DataFrame, *columns: str) -> DataFrame:
    """The fused rows with columns of the full records: at most k rows on the broadcast side."""
    return memories.select("id", *columns).join(F.broadcast(best), "id")


def hybrid(memories: DataFrame, query: Sequence[float], terms: Sequence[str], now: Column, limit: int, hours: int = 48, weights: dict[str, float] | None = None, entity: DataFrame | None = None) -> DataFrame:
    depth = 3 * limit
    legs = {"vector": vector_leg(memories, query, depth), "bm25": bm25_leg(memories, terms, depth), "recency": recency_leg(memories, now, hours, depth)}
    if entity is not None:
        legs["entity"] = entity
    return top(fuse(legs, weights), limit)


def exact_bump(hits: DataFrame, terms: Sequence[str], value_signal: Column, span: Column, weight: float = 0.05, least: float = 0.5) -> DataFrame:
    """score + weight x exact, where exact = min(1, overlap + 0.25 value + 0.1 span) is `least` or more."""
    held = F.size(F.array_intersect(tx.tokens(F.col("text")), F.lit(list(terms)))) / max(len(terms), 1)
    exact = F.least(F.lit(1.0), held + 0.25 * value_signal.cast("int") + 0.1 * span.cast("int"))
    return hits.withColumn("exact", exact).withColumn("score", F.col("score") + F.when(F.col("exact") >= least, weight * F.col("exact")).otherwise(0.0))


def rerank(hits: DataFrame, query: Sequence[float], floor: float = 0.3) -> DataFrame:
    """Cosine replaces the score; labels direct, supporting, background; below `floor`, or of another dimension, dropped."""
    same = F.size("embedding") == len(query)
    rescored = hits.where(same).withColumn("score", vec.cosine(F.col("embedding"), vec.literal(query)))
    label = F.when(F.col("score") >= 0.7, "direct").when(F.col("score") >= 0.5, "supporting").when(F.col("score") >= 0.3, "background")
    return rescored.withColumn("label", label).where(F.col("score") >= floor)


def merge_claims(hits: DataFrame, claims: DataFrame, mode: str) -> DataFrame:
    """hits(id, score), claims(id, score, supports): disabled - hits; annotation - claims at 0.6 only if there
    are no hits; primary - claims, and hits that support none of them."""
    if mode == "disabled":
        return hits
    if mode == "annotation":
        any_hit = hits.limit(1).agg(F.count("*").alias("hits"))
        shown = claims.select("id", (F.col("score") * 0.6).alias("score")).join(F.broadcast(any_hit), F.col("hits") == 0).drop("hits")
        return hits.select("id", "score").unionByName(shown)
    supported = claims.select(F.explode("supports").alias("id")).distinct()
    return claims.select("id", "score").unionByName(hits.join(supported, "id", "left_anti").select("id", "score"))
