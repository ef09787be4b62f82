"""Metrics, entity graph and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import STOPWORDS
from palimpsest.operators import graph as gr
from palimpsest.operators import metrics as mt
from palimpsest.operators import retrieval as rt
from palimpsest.plans.recall import FUSED_SQL, QVEC_SQL, TERMS, now_col, query_vector
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table

R = Registry()


@R.query(f"WITH {MEMORY_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(active, true)) AS active, count(*) FILTER (WHERE NOT coalesce(active, true)) AS inactive, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM mem")
def health_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mt.health(memory_units(spark, sf_dir, ()))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return stats.select("total", "active", "inactive", text("oldest"), text("newest"))


@R.query("SELECT event_type AS reason, count(*) AS n FROM events, (SELECT max(ts) AS m FROM events) WHERE ts > m - INTERVAL 24 HOUR GROUP BY event_type")
def rejections_per_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts")
    last = events.agg(F.max("ts").alias("m"))
    return events.join(F.broadcast(last), F.col("ts") > F.col("m") - F.expr("INTERVAL 24 HOURS")).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@R.query(f"WITH {MEMORY_SQL} SELECT DISTINCT user_id FROM mem WHERE coalesce(active, true)")
def distinct_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(F.coalesce("active", F.lit(True))).select("user_id").distinct()


@R.query("SELECT l_suppkey AS entity, count(DISTINCT l_partkey) AS mentions FROM lineitem GROUP BY l_suppkey")
def entity_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.countDistinct("l_partkey").alias("mentions"))


@R.query("SELECT lower(event_type) AS mention, count(*) AS n, list_sort(list(DISTINCT (user_id % 3)::VARCHAR)) AS reasons FROM events WHERE length(event_type) >= 3 GROUP BY ALL")
def miss_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.length("event_type") >= 3)
    return rows.groupBy(F.lower("event_type").alias("mention")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set((F.col("user_id") % 3).cast("string"))).alias("reasons"))


@R.query("SELECT event_type, n, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = ceil(0.95 * n)")
def retrieval_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95).select("event_type", "n", F.col("value").alias("p95"))


@R.query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def linear_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mt.linear_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.5, 0.9, 0.95))
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "mean")])


NDCG_SQL = """r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, (event_id % 4)::DOUBLE AS relevance FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, rank) AS best FROM r),
g AS (SELECT user_id, sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + 1.0) ELSE 0.0 END) AS dcg, sum(CASE WHEN best <= 5 THEN relevance / log2(best + 1.0) ELSE 0.0 END) AS idcg FROM b GROUP BY user_id)"""


@R.query(f"WITH {NDCG_SQL} SELECT user_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM g")
def ndcg_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ranked = table(spark, sf_dir, "events").select("user_id", rank.alias("rank"), (F.col("event_id") % 4).cast("double").alias("relevance"))
    return mt.ndcg(ranked, ["user_id"]).withColumn("ndcg", F.round("ndcg", 6))


@R.query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY value + event_id % 50 DESC, event_id) AS y FROM events)
SELECT user_id, round(count(*) FILTER (WHERE x > 5) / count(*), 6) AS flip_rate FROM a WHERE y <= 5 GROUP BY user_id""")
def boundary_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "value")
    base = rt.top_per(events, ["user_id"], 5, F.desc("value"), F.asc("id"))
    changed = rt.top_per(events, ["user_id"], 5, (F.col("value") + F.col("id") % 50).desc(), F.asc("id"))
    return mt.boundary_flips(base, changed, ["user_id"], 5).withColumn("flip_rate", F.round("flip_rate", 6))


@R.query(f"""WITH {MEMORY_SQL}, h AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM mem), g AS (SELECT user_id, id FROM mem WHERE quality = 1 AND tier = 'durable'),
m AS (SELECT h.user_id, h.id, h.rank, g.id IS NOT NULL AS hit FROM h LEFT JOIN g ON g.user_id = h.user_id AND g.id = h.id WHERE rank <= 10),
s AS (SELECT user_id, count(*) AS returned, count(*) FILTER (WHERE hit) AS found, min(rank) FILTER (WHERE hit)::INTEGER AS first_rank, avg(rank) FILTER (WHERE hit) AS mean_rank FROM m GROUP BY user_id)
SELECT w.user_id, coalesce(found, 0) AS found, first_rank, round(mean_rank, 6) AS mean_rank, round(coalesce(found, 0) / relevant, 6) AS recall, round(CASE WHEN returned > 0 THEN found / returned ELSE 0.0 END, 6) AS precision
FROM (SELECT user_id, count(*) AS relevant FROM g GROUP BY user_id) w LEFT JOIN s USING (user_id)""")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = memory_units(spark, sf_dir, ("labels",)).select("user_id", "id", "created_at", "quality", "tier")
    hits = rt.top_per(mem, ["user_id"], 10, F.desc("created_at"), F.asc("id")).select("user_id", "id", "rank")
    scores = mt.retrieval_scores(hits, mem.where("quality = 1 and tier = 'durable'").select("user_id", "id"), "user_id")
    return scores.select("user_id", "found", "first_rank", *[F.round(c, 6).alias(c) for c in ("mean_rank", "recall", "precision")])


@R.query(f"""WITH {MEMORY_SQL}, {QVEC_SQL}, {FUSED_SQL}, c AS (SELECT id % 10 AS c, id, vector_rank, bm25_rank, recency_rank, id % 3 = 0 AS relevant FROM fused),
grid AS (SELECT 'even' AS variant, 1.0::DOUBLE AS v, 1.0::DOUBLE AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'lexical', 0.5, 2.0, 0.2 UNION ALL SELECT 'recent', 0.5, 0.5, 2.0),
sc AS (SELECT variant, c, id, relevant, coalesce(v / (60 + vector_rank), 0.0) + coalesce(b / (60 + bm25_rank), 0.0) + coalesce(r / (60 + recency_rank), 0.0) AS score FROM c, grid),
k AS (SELECT *, row_number() OVER (PARTITION BY variant, c ORDER BY round(score, 9) DESC, id) AS k FROM sc)
SELECT variant, count(*) AS cases, round(avg(relevant::INTEGER), 6) AS accuracy FROM k WHERE k = 1 GROUP BY variant""")
def replay_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = memory_units(spark, sf_dir, ("embeddings",))
    legs = {"vector": rt.vector_leg(memories, query_vector(spark, sf_dir), 45), "bm25": rt.bm25_leg(memories, TERMS, 45), "recency": rt.recency_leg(memories, now_col(), 48, 45)}
    cases = rt.fuse(legs).select((F.col("id") % 10).alias("case"), "id", "vector_rank", "bm25_rank", "recency_rank", (F.col("id") % 3 == 0).alias("relevant"))
    return mt.replay_grid(cases, [("even", 1.0, 1.0, 1.0), ("lexical", 0.5, 2.0, 0.2), ("recent", 0.5, 0.5, 2.0)]).withColumn("accuracy", F.round("accuracy", 6))


@R.query(f"""WITH {MEMORY_SQL}, u AS (SELECT category, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS v FROM mem WHERE embedding IS NOT NULL),
l AS (SELECT category, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM u), m AS (SELECT category, i, avg(x) AS x FROM l GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY category)) AS len FROM m)
SELECT category, i::INTEGER AS i, round(x / len, 6) AS x FROM n""")
def category_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mt.centroids(memory_units(spark, sf_dir, ("embeddings",)).select("category", "embedding"), "category")
    return c.select("category", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"


@R.query(f"WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x)) AS w FROM conversations) SELECT conv_id, turn, role, round(CASE WHEN len(w) < 4 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END, 6) AS density FROM w")
def lexical_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.round(mt.lexical_density(F.col("text"), STOPWORDS), 6).alias("density"))


EDGES = "e AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS id FROM lineitem)"
PAIR_SQL = f"""{EDGES}, n AS (SELECT id, count(*) AS n FROM e GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.entity = y.entity AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT a, b, shared, shared / (p.n + q.n - shared) AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE shared / (p.n + q.n - shared) > 0.3)"""


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem is an edge."""
    return gr.shared_pairs(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("id")))


@R.query(f"WITH {PAIR_SQL} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM pairs")
def entity_jaccard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 6))


@R.query(f"""WITH RECURSIVE {PAIR_SQL}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT w.id, e.b FROM walk w JOIN both_ways e ON e.a = w.other),
l AS (SELECT id, min(other) AS cluster FROM walk GROUP BY id) SELECT cluster, count(*) AS n, sha256(string_agg(id::VARCHAR, ',' ORDER BY id))[1:16] AS fingerprint FROM l GROUP BY cluster""")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gr.clusters(entity_pairs(spark, sf_dir))
    return found.groupBy("cluster").agg(F.count("*").alias("n"), gr.fingerprint(F.collect_list("id")).alias("fingerprint"))


@R.query("""WITH m AS (SELECT DISTINCT lower(p_brand) AS mention FROM part UNION SELECT DISTINCT lower(p_type) FROM part), e AS (SELECT p_partkey AS entity, lower(p_brand) AS name_norm, [lower(p_type)] AS aliases FROM part),
x AS (SELECT mention, entity, 0 AS via FROM m JOIN e ON name_norm = mention UNION ALL SELECT mention, entity, 1 FROM m JOIN (SELECT entity, unnest(aliases) AS a FROM e) ON a = mention),
k AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY via, entity) AS k FROM x) SELECT mention, entity, CASE via WHEN 0 THEN 'name' ELSE 'alias' END AS via FROM k WHERE k = 1""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mentions = part.select(F.lower("p_brand").alias("mention")).union(part.select(F.lower("p_type"))).distinct()
    return gr.by_name_or_alias(mentions, part.select(F.col("p_partkey").alias("entity"), F.lower("p_brand").alias("name_norm"), F.array(F.lower("p_type")).alias("aliases_norm")))


@R.query("""WITH m AS (SELECT DISTINCT left(lower(p_name), 6) AS mention FROM part), e AS (SELECT p_partkey AS entity, lower(p_name) AS name_norm FROM part),
x AS (SELECT mention, count(*) AS n, min(entity) AS entity FROM m JOIN e ON length(mention) >= 4 AND length(name_norm) >= 4 AND (starts_with(mention, name_norm) OR starts_with(name_norm, mention))
  AND least(length(mention), length(name_norm)) / greatest(length(mention), length(name_norm)) >= 0.5 GROUP BY mention) SELECT mention, entity FROM x WHERE n = 1""")
def entity_prefix_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return gr.prefix_matches(part.select(F.left(F.lower("p_name"), F.lit(6)).alias("mention")).distinct(), part.select(F.col("p_partkey").alias("entity"), F.lower("p_name").alias("name_norm")))


@R.query("""WITH m AS (SELECT p_brand AS name, [p_type, p_brand] AS aliases, p_name AS description, p_retailprice / 3000 AS confidence, p_partkey AS seen_at FROM part)
SELECT name, list_sort(list_distinct(flatten(list(aliases)))) AS aliases, arg_max(description, (length(description), description)) AS description, round(max(confidence), 6) AS confidence, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM m GROUP BY name""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.array("p_type", "p_brand").alias("aliases"), F.col("p_name").alias("description"), (F.col("p_retailprice") / 3000).alias("confidence"), F.col("p_partkey").alias("seen_at"))
    return gr.merged_entities(rows, ["name"]).withColumn("confidence", F.round("confidence", 6))


@R.query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def orphan_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(linked, "id", "left_anti")


@R.query("SELECT entity, src, n FROM (SELECT s_suppkey AS entity, n_name AS src, count(*) OVER (PARTITION BY n_name) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def entity_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    sizes = joined.groupBy("n_name").agg(F.count("*").alias("n"))
    return joined.join(sizes, "n_name").select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("src"), "n")
