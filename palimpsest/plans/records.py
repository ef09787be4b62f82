"""Records over their life: supersede, forget, restore, and the filters and reads around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import records as rc
from palimpsest.plans.recall import COSINE
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()
STATE_SQL = f"{MEMORY_SQL}, rec AS (SELECT id, user_id, active, CASE WHEN id % 3 = 0 THEN id - 1000 END AS lineage_root FROM mem)"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", "user_id", "active", F.when(F.col("id") % 3 == 0, F.col("id") - 1000).alias("lineage_root"))


@R.query(f"""WITH {STATE_SQL}, d AS (SELECT n.id AS new_id, o.id AS old_id, coalesce(o.lineage_root, o.id) AS root FROM rec n JOIN rec o ON o.id = n.id - 20 AND o.user_id = n.user_id WHERE n.id % 8 = 0)
SELECT r.id, r.user_id, CASE WHEN g.new_id IS NOT NULL THEN false WHEN c.old_id IS NOT NULL THEN true ELSE r.active END AS active, coalesce(c.root, r.lineage_root) AS lineage_root, g.new_id AS superseded_by, c.old_id AS supersedes
FROM rec r LEFT JOIN d g ON g.old_id = r.id LEFT JOIN d c ON c.new_id = r.id""")
def supersede_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth record supersedes the one twenty before it, where both are one tenant's."""
    rows = state(spark, sf_dir)
    return rc.supersede(rows, rows.where("id % 8 = 0").select(F.col("id").alias("new_id"), (F.col("id") - 20).alias("old_id"), "user_id"))


@R.query(f"""WITH {MEMORY_SQL} SELECT id, user_id, CASE WHEN id % 13 = 0 AND user_id = 'src1' THEN false ELSE active END AS active, CASE WHEN id % 13 = 0 AND user_id = 'src1' THEN 'forgotten' WHEN active = false THEN 'old' END AS inactive_reason FROM mem""")
def forget_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 13 are asked for by one tenant: only its own are forgotten."""
    rows = memory_units(spark, sf_dir, ()).select("id", "user_id", "active", F.when(~F.col("active"), "old").alias("inactive_reason"))
    return rc.forget(rows, rows.where("id % 13 = 0").select("id", F.lit("src1").alias("user_id"))).select("id", "user_id", "active", "inactive_reason")


@R.query(f"WITH {MEMORY_SQL} SELECT id, user_id FROM mem WHERE NOT (id % 13 = 0 AND user_id = 'src1')")
def erase_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ()).select("id", "user_id")
    return rc.forget(rows, rows.where("id % 13 = 0").select("id", F.lit("src1").alias("user_id")), hard=True)


@R.query(f"""WITH {MEMORY_SQL} SELECT id, user_id, CASE WHEN id % 2 = 0 AND NOT coalesce(active, false) THEN true ELSE active END AS active, CASE WHEN id % 2 = 0 AND NOT coalesce(active, false) THEN NULL WHEN active = false THEN 'old' END AS inactive_reason FROM mem""")
def restore_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ()).select("id", "user_id", "active", F.when(~F.col("active"), "old").alias("inactive_reason"))
    return rc.restore(rows, rows.where("id % 2 = 0").select("id", "user_id")).select("id", "user_id", "active", "inactive_reason")


@R.query(f"WITH {MEMORY_SQL} SELECT id, CASE WHEN memory_role IN ('session_handoff', 'project_state') AND path = '/repo/1' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}') THEN TIMESTAMP '{NOW}' ELSE invalid_at END AS invalid_at FROM mem")
def continuity_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.invalidated(memory_units(spark, sf_dir, ()), ["session_handoff", "project_state"], now(), "/repo/1").select("id", "invalid_at")


@R.query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(l.toxic = 1, false)")
def stale_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxic label stands for the stale flag: true, false or null."""
    return memory_units(spark, sf_dir, ("labels",)).withColumn("stale", F.col("toxic") == 1).where(rc.not_stale("stale")).select("id")


@R.query(f"WITH {MEMORY_SQL} SELECT id FROM mem WHERE path = '/repo/1' AND lang = 'en'")
def attribution_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).withColumn("client", F.col("lang")).where(rc.attributed("/repo/1", "en")).select("id")


@R.query(f"WITH {MEMORY_SQL} SELECT id FROM mem WHERE access_count >= 3 AND quality = 0 AND coalesce(active, true)")
def learned_noise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ("labels",)).withColumns({"status_retrieved": F.col("access_count"), "used": F.col("quality")})
    return rows.where(rc.learned_noise()).select("id")


@R.query(f"WITH {MEMORY_SQL} SELECT id, round(((id * 37) % 101) / 100.0 * CASE WHEN coalesce(lang, '') = '' THEN 1.0 WHEN lang = 'de' THEN 1.08 ELSE 0.72 END, 6)::DOUBLE AS score FROM mem")
def preferred_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = memory_units(spark, sf_dir, ()).select("id", (F.col("id") * 37 % 101 / 100.0).alias("score"), F.col("lang").alias("client"))
    return rc.prefer_client(hits, "de", "prefer").select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, CASE WHEN category IN ('profile', 'preferences') THEN 'durable' WHEN confidence < 0.5 THEN 'ephemeral' WHEN category IN ('cases', 'events') AND confidence >= 0.9 THEN 'durable' ELSE 'working' END AS tier FROM mem")
def resolved_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).select("id", rc.resolved_tier(F.col("category"), F.col("confidence")).alias("tier"))


@R.query("""WITH c AS (SELECT source, count(*) AS committed, count(e.vec_id) AS indexed FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source)
SELECT source, committed, indexed, round((committed - indexed) / committed, 6) AS ratio, (committed - indexed) / committed > 0.05 AS breach, committed >= indexed AS holds FROM c""")
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    counts = rows.groupBy("source").agg(F.count("*").alias("committed"), F.count("vec_id").alias("indexed"))
    return rc.drift(counts).withColumn("ratio", F.round("ratio", 6))


@R.query(f"""WITH {MEMORY_SQL}, q AS (SELECT * FROM mem WHERE id % 100 = 0 AND embedding IS NOT NULL),
s AS (SELECT q.id AS query_id, {COSINE.format(a="q.embedding", b="m.embedding")} AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY {COSINE.format(a="q.embedding", b="m.embedding")} DESC, m.id) AS k
  FROM q JOIN mem m ON m.user_id = q.user_id AND m.scope = q.scope AND m.session_id <> q.session_id WHERE m.scope <> 'global' AND m.active AND m.embedding IS NOT NULL)
SELECT q.id AS query_id, count(s.k) AS nearest, round(1 - coalesce(max(similarity), 0.0), 6) AS novelty FROM q LEFT JOIN s ON s.query_id = q.id AND k <= 10 GROUP BY q.id""")
def session_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: records whose id is divisible by 100, against all."""
    rows = memory_units(spark, sf_dir, ("embeddings",)).where("embedding is not null")
    return rc.novelty(rows.where("id % 100 = 0"), rows).withColumn("novelty", F.round("novelty", 6))


@R.query("""WITH c AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS id FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS cluster, l_partkey AS id FROM lineitem), n AS (SELECT g, count(*) AS n FROM c GROUP BY g),
o AS (SELECT g, cluster, count(*) AS overlap FROM c JOIN m USING (id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY overlap DESC, cluster) AS k FROM o JOIN n USING (g) WHERE overlap >= 0.5 * n)
SELECT g AS "group", cluster, overlap FROM k WHERE k = 1""")
def cluster_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts are a candidate group, a supplier's parts an existing cluster."""
    line = table(spark, sf_dir, "lineitem")
    return rc.reconciled(line.select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("id")), line.select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("id")))


CLUSTERS_SQL = "c AS (SELECT l_orderkey AS cluster, count(DISTINCT l_suppkey) AS size FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, CASE WHEN size = 1 THEN 'singleton' ELSE 'entity' END AS method, CASE WHEN cluster % 3 <> 0 THEN size - cluster % 4 END AS last_count FROM c)"


@R.query(f"WITH {CLUSTERS_SQL} SELECT cluster, size FROM s WHERE size >= 3 AND method <> 'singleton' AND (last_count IS NULL OR size - last_count >= 2)")
def synthesis_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster")).agg(F.countDistinct("l_suppkey").alias("size"))
    known = sizes.withColumns({"method": F.when(F.col("size") == 1, "singleton").otherwise("entity"), "last_count": F.when(F.col("cluster") % 3 != 0, F.col("size") - F.col("cluster") % 4)})
    return known.where(rc.synthesis_ready(known)).select("cluster", "size")


@R.query(f"WITH {MEMORY_SQL} SELECT user_id, id, path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN path = '/repo/1' THEN 0 WHEN path IS NULL THEN 1 ELSE 2 END, created_at DESC, id) AS k FROM mem WHERE memory_role = 'project_state') WHERE k = 1")
def project_state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = memory_units(spark, sf_dir, ()).where("memory_role = 'project_state'")
    return rc.state_of_path(states, ["user_id"], "/repo/1").select("user_id", "id", "path")


@R.query("""WITH e AS (SELECT user_id AS gap, count(*) AS n, max(value) AS score, CASE user_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'reported' END AS status FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
s AS (SELECT user_id AS gap, count(*) AS n, max(value) AS score, NULL AS status FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT gap, coalesce(max(status), 'open') AS status, sum(n)::BIGINT AS n, round(max(score), 6) AS score FROM (SELECT gap, status, n, score FROM e UNION ALL SELECT gap, status, n, score FROM s) GROUP BY gap""")
def gap_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are the gaps known so far, odd ones those seen now."""
    events = table(spark, sf_dir, "events")
    counted = lambda rows: rows.groupBy(F.col("user_id").alias("gap")).agg(F.count("*").alias("n"), F.max("value").alias("score"))
    known = counted(events.where("event_id % 2 = 0")).withColumn("status", F.when(F.col("gap") % 3 == 0, "resolved").when(F.col("gap") % 3 == 1, "reported"))
    return rc.upserted_gaps(known, counted(events.where("event_id % 2 = 1"))).withColumn("score", F.round("score", 6))


@R.query(f"WITH {MEMORY_SQL} SELECT id, user_id FROM mem SEMI JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem) USING (id) WHERE coalesce(active, true) AND (scope = 'user' OR scope IS NULL)")
def linked_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    rows = memory_units(spark, sf_dir, ()).where(F.coalesce("active", F.lit(True)) & ((F.col("scope") == "user") | F.col("scope").isNull()))
    return rows.join(linked, "id", "left_semi").select("id", "user_id")


@R.query("SELECT user_id, count(*) AS misses FROM events WHERE value = 0 OR event_type = 'error' GROUP BY user_id")
def users_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value = 0 or event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("misses"))


@R.query(f"WITH {MEMORY_SQL} SELECT session_id, id FROM mem WHERE (quality IS NULL OR embedding IS NULL) AND coalesce(active, true)")
def unenriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records that lack a label or a vector, by session."""
    return memory_units(spark, sf_dir).where("(quality is null or embedding is null) and coalesce(active, true)").select("session_id", "id")


@R.query(f"WITH {MEMORY_SQL} SELECT id FROM mem WHERE path IN ('/repo/0', '/repo/2') OR session_id = 's7'")
def session_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project key in a list, or the workspace's fingerprint."""
    return memory_units(spark, sf_dir, ()).where(F.col("path").isin("/repo/0", "/repo/2") | (F.col("session_id") == "s7")).select("id")
