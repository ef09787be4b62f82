"""Lifecycle maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as lc
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def age(c: str) -> str:
    return f"((epoch(TIMESTAMP '{NOW}') - epoch({c})) / 3600.0)"


CONF = "least(greatest(coalesce(confidence, 0.0), 0.0), 1.0)"
VITALITY = f"CASE WHEN pinned THEN 1.0 ELSE (pow(0.5, {age('coalesce(last_accessed_at, created_at)')} / CASE tier WHEN 'ephemeral' THEN 3.0 WHEN 'durable' THEN 672.0 ELSE 48.0 END) + least(1.0, access_count / 5.0) + {CONF}) / 3.0 END"


@R.query(f"WITH {MEMORY_SQL} SELECT id, round({VITALITY}, 6) AS vitality FROM mem WHERE coalesce(active, true)")
def decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).where(F.coalesce("active", F.lit(True))).select("id", F.round(lc.vitality(now()), 6).alias("vitality"))


@R.query(f"""WITH {MEMORY_SQL}, a AS (SELECT *, {VITALITY} AS vitality FROM mem WHERE coalesce(active, true)), n AS (SELECT user_id, floor(count(*) * 0.05) AS most FROM a GROUP BY user_id),
e AS (SELECT user_id, id, vitality, row_number() OVER (PARTITION BY user_id ORDER BY vitality, id)::INTEGER AS turn FROM a WHERE vitality < 0.10 AND {age('created_at')} > 720 AND {CONF} < 0.7 AND tier <> 'durable' AND NOT pinned)
SELECT user_id, id, round(vitality, 6) AS vitality, turn FROM e JOIN n USING (user_id) WHERE turn <= most""")
def decay_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.prune(memory_units(spark, sf_dir, ("labels",)), ["user_id"], now()).withColumn("vitality", F.round("vitality", 6))


@R.query(f"""WITH {MEMORY_SQL} SELECT id, tier, CASE WHEN tier = 'ephemeral' AND (access_count >= 2 OR {CONF} >= 0.9) AND {age('created_at')} >= 1 THEN 'working'
  WHEN tier = 'working' AND access_count >= 3 AND {CONF} >= 0.8 AND {age('created_at')} >= 24 THEN 'durable' ELSE tier END AS new_tier FROM mem WHERE coalesce(active, true)""")
def tier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).where(F.coalesce("active", F.lit(True))).select("id", "tier", lc.promoted_tier(now()).alias("new_tier"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, round(access_count * pow(0.5, {age('coalesce(last_accessed_at, created_at)')} / 168.0), 6) AS score FROM mem")
def access_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).select("id", F.round(lc.access_score(now()), 6).alias("score"))


TOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1))"
FEEDBACK = f"""{MEMORY_SQL}, f AS (SELECT m.id, m.confidence AS prior, c.conv_id % 11 = 0 AS corrected, c.conv_id % 2 = 0 AS cross_session,
  0.65 * CASE WHEN len({TOK('m.text')}) = 0 THEN 0.0 ELSE len(list_intersect({TOK('m.text')}, {TOK('c.text')})) / len({TOK('m.text')}) END
  + 0.35 * CASE c.conv_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.45 WHEN 3 THEN 0.0 ELSE 0.7 END - CASE WHEN c.conv_id % 11 = 0 THEN 0.7 ELSE 0.0 END + CASE WHEN c.conv_id % 2 = 0 THEN 0.05 ELSE 0.0 END AS raw
  FROM mem m JOIN conversations c ON c.conv_id = m.id AND c.role = 'assistant'),
e AS (SELECT *, least(greatest(raw, 0.0), 1.0) AS ev FROM f),
u AS (SELECT id, least(greatest(coalesce(max(prior), 0.5), 0.0), 1.0) AS p, sum(ev) AS s, sum(1 - ev) AS t, count(*) AS retrieved, count(*) FILTER (WHERE ev >= 0.35) AS used, count(*) FILTER (WHERE ev >= 0.7 AND NOT corrected) AS successful,
  count(*) FILTER (WHERE ev >= 0.7 AND NOT corrected AND cross_session) AS cross_used, count(*) FILTER (WHERE corrected) AS contradictions FROM e GROUP BY id),
b AS (SELECT *, 1 + 4 * p + s AS alpha, 1 + 4 * (1 - p) + t AS beta FROM u)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn of conversation i is an answer that used memory i."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("text").alias("answer"))
    names = F.array(*[F.lit(v) for v in ("explicit_success", "implicit_success", "rephrased", "failure", "other")])
    rows = memory_units(spark, sf_dir, ("labels",)).select("id", "text", F.col("confidence").alias("prior")).join(turns, "id")
    rows = rows.withColumns({"resolution": F.get(names, (F.col("id") % 5).cast("int")), "corrected": F.col("id") % 11 == 0, "cross_session": F.col("id") % 2 == 0})
    return rows.withColumn("evidence", lc.evidence(F.col("text"), F.col("answer"), F.col("resolution"), F.col("corrected"), F.col("cross_session")))


@R.query(f"WITH {FEEDBACK} SELECT id, retrieved, used, successful, cross_used, contradictions, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS usefulness FROM b")
def usefulness_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.usefulness(feedback(spark, sf_dir), ["id"]).select("id", "retrieved", "used", "successful", "cross_used", "contradictions", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "usefulness")])


PROMOTION = "0.45 * (alpha / (alpha + beta)) + 0.30 * alpha / greatest(alpha + beta, 1.0) + 0.20 * p + 0.05 * (1 - contradictions / retrieved)"


@R.query(f"WITH {FEEDBACK} SELECT id, round({PROMOTION}, 6) AS score, {PROMOTION} >= 0.78 AND used >= 3 AND cross_used >= 2 AND contradictions = 0 AS promote FROM b")
def claim_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality snapshot and the claim gate; of uses at least two come from other sessions."""
    rows = feedback(spark, sf_dir)
    prior = rows.groupBy("id").agg(F.max("prior").alias("prior"))
    u = lc.usefulness(rows, ["id"]).join(prior, "id")
    score = lc.quality_snapshot(F.col("usefulness"), F.col("alpha"), F.col("beta"), F.col("prior"), F.col("contradictions"), F.col("retrieved"))
    return u.select("id", F.round(score, 6).alias("score"), ((score >= 0.78) & (F.col("used") >= 3) & (F.col("cross_used") >= 2) & (F.col("contradictions") == 0)).alias("promote"))


@R.query(f"WITH {MEMORY_SQL} SELECT id FROM mem WHERE NOT coalesce(active, true) AND created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY")
def soft_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(~F.coalesce("active", F.lit(True)) & (F.col("created_at") < now() - F.expr("INTERVAL 90 DAYS"))).select("id")


@R.query("SELECT o_custkey, o_orderkey AS id, row_number() OVER w AS revision, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by, first_value(o_orderkey) OVER w AS root FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), "o_orderdate")
    return lc.lineage(orders, "o_custkey", F.asc("o_orderdate"), F.asc("id")).drop("o_orderdate")


SESSIONS = """s0 AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)),
sessions AS (SELECT user_id, count(*) AS n, min(ts) AS opened_at, max(ts) AS closed_at FROM s0 GROUP BY user_id, k)"""


@R.query(f"WITH {SESSIONS} SELECT user_id, n, opened_at, closed_at FROM sessions")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.idle_sessions(table(spark, sf_dir, "events"), ["user_id"], "12 hours").select("user_id", "n", "opened_at", "closed_at")


BOUND = f"""WITH {SESSIONS}, t AS (SELECT user_id, opened_at, closed_at, user_id || ':' || floor(epoch(opened_at))::BIGINT AS session_id FROM sessions)
"""


@R.query(BOUND + """, m AS (SELECT e.event_id AS evidence_id, e.user_id, t.session_id, row_number() OVER (PARTITION BY e.event_id ORDER BY floor(epoch(closed_at)) - floor(epoch(opened_at)), opened_at DESC, session_id) AS k
  FROM events e JOIN t ON t.user_id = e.user_id AND e.ts BETWEEN t.opened_at AND t.closed_at) SELECT evidence_id, user_id, session_id FROM m WHERE k = 1""")
def evidence_session_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sessions = lc.idle_sessions(events, ["user_id"], "12 hours").withColumn("session_id", F.concat_ws(":", F.col("user_id").cast("string"), F.unix_seconds(F.col("opened_at").cast("timestamp")).cast("string")))
    return lc.bind_to_sessions(events.select(F.col("event_id").alias("evidence_id"), "user_id", "ts"), sessions, "user_id", now())


@R.query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'passage'))")
def missing_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    handoffs = turns.where(F.contains(F.lower("text"), F.lit("passage")))
    return lc.missing_handoffs(turns.select("conv_id").distinct(), turns.where("role = 'assistant'"), handoffs, "conv_id")


@R.query("WITH n AS (SELECT trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS norm FROM conversations) SELECT sha256(norm) AS fingerprint, count(*) AS n, min(norm) AS item, 'list' AS kind, least(0.99, 0.1 * count(*))::DOUBLE AS score FROM n GROUP BY norm")
def recurring_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.recurring_gaps(table(spark, sf_dir, "conversations").select(F.col("text").alias("item")), [], "list").withColumn("score", F.col("score").cast("double"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, user_id, row_number() OVER (PARTITION BY text_norm ORDER BY created_at DESC, id) = 1 AS keeps FROM mem")
def tenant_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each normalised text stays, whatever its tenant: the newest."""
    rows = memory_units(spark, sf_dir, ()).select("id", "user_id", F.xxhash64("text_norm").alias("fact_key"), "created_at")
    return lc.newest_per_key(rows, ["fact_key"], F.desc("created_at"), F.asc("id")).select("id", "user_id", "keeps")


@R.query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT ts::DATE) >= 5 AND max(ts) - min(ts) >= INTERVAL 24 HOUR")
def sweep_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.where((F.col("days") >= 5) & (F.col("b") - F.col("a") >= F.expr("INTERVAL 24 HOURS"))).select("user_id")


@R.query(f"WITH {MEMORY_SQL} SELECT id, CASE WHEN user_id = 'src1' THEN 'durable' ELSE tier END AS tier, active FROM mem")
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = memory_units(spark, sf_dir, ()).select("id", "tier", "active", "user_id")
    changes = current.where("user_id = 'src1'").withColumn("tier", F.lit("durable"))
    return lc.merge(current, changes, "id").select("id", "tier", "active")
