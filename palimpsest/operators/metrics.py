"""Aggregates and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def health(rows: DataFrame) -> DataFrame:
    active = F.coalesce("active", F.lit(True))
    return rows.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at index ceil(q n) - 1 of each group: values are counted first, so that a window sees each
    distinct value once."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    known = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    return known.where(F.col("upto") >= F.ceil(q * F.col("n"))).groupBy(*by).agg(F.min(value).alias("value"), F.max("n").alias("n"))


def linear_percentiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """Interpolated percentiles and the mean."""
    return rows.groupBy(*by).agg(*[F.percentile(value, q).alias(f"p{round(q * 100)}") for q in qs], F.avg(value).alias("mean"))


def ndcg(ranked: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """ranked(by.., rank, relevance): discounted gain of the first k over that of the best k; 0 without gain."""
    ideal = ranked.withColumn("best", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), "rank")))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("relevance") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sums = ideal.groupBy(*by).agg(gain("rank").alias("dcg"), gain("best").alias("idcg"))
    return sums.select(*by, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def boundary_flips(base: DataFrame, changed: DataFrame, by: list[str], window: int) -> DataFrame:
    """The share of the changed ranking's first `window` that the base's first `window` does not have."""
    old = base.where(F.col("rank") <= window).select(*by, "id", F.lit(1).alias("had"))
    new = changed.where(F.col("rank") <= window).select(*by, "id")
    joined = new.join(old, [*by, "id"], "left")
    return joined.groupBy(*by).agg((F.count_if(F.col("had").isNull()) / F.count("*")).alias("flip_rate"))


def retrieval_scores(hits: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """hits(by, id, rank), gold(by, id): recall, precision, first and mean relevant rank per query."""
    marked = hits.join(gold.withColumn("hit", F.lit(1)), [by, "id"], "left")
    got = marked.groupBy(by).agg(F.count("*").alias("returned"), F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"), F.avg(F.when(F.col("hit") == 1, F.col("rank"))).alias("mean_rank"))
    want = gold.groupBy(by).agg(F.count("*").alias("relevant"))
    both = want.join(got, by, "left").na.fill(0, ["returned", "found"])
    return both.withColumns({"recall": F.col("found") / F.col("relevant"), "precision": F.when(F.col("returned") > 0, F.col("found") / F.col("returned")).otherwise(0.0)})


def replay_grid(cases: DataFrame, variants: list[tuple[str, float, float, float]]) -> DataFrame:
    """cases(case, vector_rank, bm25_rank, recency_rank, id, relevant): each variant's weights re-score every
    case's candidates; accuracy is the share of cases whose best candidate is relevant. Variants are an
    array of constants exploded in each row."""
    grid = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(a).alias("v"), F.lit(b).alias("b"), F.lit(c).alias("r")) for n, a, b, c in variants])
    part = lambda w, r: F.coalesce(F.col(f"g.{w}") / (60 + F.col(r)), F.lit(0.0))
    scored = cases.withColumn("g", F.explode(grid)).withColumn("score", part("v", "vector_rank") + part("b", "bm25_rank") + part("r", "recency_rank"))
    first = Window.partitionBy("g.variant", "case").orderBy(F.desc(F.round("score", 9)), "id")
    best = scored.withColumn("k", F.row_number().over(first)).where("k = 1")
    return best.groupBy(F.col("g.variant").alias("variant")).agg(F.count("*").alias("cases"), F.avg(F.col("relevant").cast("double")).alias("accuracy"))


def centroids(rows: DataFrame, by: str) -> DataFrame:
    """Mean of the L2-normalised vectors of each type, renormalised: exploded by component, averaged with
    map-side combining, gathered again in order."""
    from palimpsest.functions import vectors as vec

    long = rows.where(F.col("embedding").isNotNull()).select(by, F.posexplode(vec.normalised(F.col("embedding"))).alias("i", "x"))
    means = long.groupBy(by, "i").agg(F.avg("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy(by).agg(mean.alias("mean")).select(by, vec.normalised(F.col("mean")).alias("centroid"))


def lexical_density(text: Column, stop: frozenset[str]) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(F.lit(sorted(stop)), w))
    return F.when(F.size(words) < 4, 0.0).otherwise(F.size(F.array_distinct(words)) / F.size(words))
