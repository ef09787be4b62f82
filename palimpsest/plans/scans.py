"""Scans, predicates, row shaping and sinks expressed as results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import predicates as pr
from palimpsest.operators import retrieval as rt
from palimpsest.operators import shaping as sh
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()
ACTIVE = "coalesce(active, true)"
VALID = f"(invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}')"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def rx(text: str, patterns: tuple[str, ...]) -> str:
    """Any of the patterns, for RE2."""
    return "(" + " OR ".join(f"regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


@R.query(f"WITH {MEMORY_SQL} SELECT id, created_at FROM mem WHERE user_id = 'src0' AND {ACTIVE} ORDER BY created_at DESC, id LIMIT 100")
def tenant_active_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ()).where((F.col("user_id") == "src0") & pr.is_active())
    return rows.orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at")


@R.query(f"WITH {MEMORY_SQL} SELECT id, text, tier FROM mem WHERE id = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where("id = 7").select("id", "text", "tier")


@R.query(f"WITH {MEMORY_SQL} SELECT id, created_at FROM mem WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND {ACTIVE} ORDER BY created_at DESC, id LIMIT 200")
def time_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ()).where((F.col("created_at") > now() - F.expr("INTERVAL 14 DAYS")) & pr.is_active())
    return rows.orderBy(F.desc("created_at"), "id").limit(200).select("id", "created_at")


@R.query(f"WITH {MEMORY_SQL} SELECT id, user_id, tier FROM mem WHERE id IN (SELECT item_id FROM benchmark)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return memory_units(spark, sf_dir, ()).join(ids, "id", "left_semi").select("id", "user_id", "tier")


@R.query(f"WITH {MEMORY_SQL} SELECT id, scope, category, confidence FROM mem WHERE {ACTIVE}")
def active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).where(pr.is_active()).select("id", "scope", "category", "confidence")


@R.query(f"""WITH {MEMORY_SQL} SELECT id, memory_role, created_at FROM mem WHERE {ACTIVE} AND {VALID} AND (memory_role IN ('current_status', 'session_handoff', 'debugging_active', 'planning_active', 'project_state')
  OR memory_role = 'recent_work' OR (category IN ('entities', 'events') AND tier = 'working' AND created_at > TIMESTAMP '{NOW}' - INTERVAL 14 DAY))""")
def continuity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("memory_role").isin("current_status", "session_handoff", "debugging_active", "planning_active", "project_state")
    passing = F.col("category").isin("entities", "events") & (F.col("tier") == "working") & (F.col("created_at") > now() - F.expr("INTERVAL 14 DAYS"))
    return memory_units(spark, sf_dir, ()).where(pr.is_active() & pr.is_valid(now()) & (state | (F.col("memory_role") == "recent_work") | passing)).select("id", "memory_role", "created_at")


@R.query(f"WITH {MEMORY_SQL} SELECT id, session_id, created_at FROM mem WHERE session_id IN ('s1', 's2', 's3') AND created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
def cursor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(F.col("session_id").isin("s1", "s2", "s3") & (F.col("created_at") > now() - F.expr("INTERVAL 30 DAYS"))).select("id", "session_id", "created_at")


@R.query("SELECT conv_id, turn, role, text FROM conversations WHERE turn >= 1")
def turn_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("turn >= 1").select("conv_id", "turn", "role", "text")


@R.query("SELECT conv_id, turn, role, trim(regexp_replace(text, '<relevant-memories>.*?</relevant-memories>', '', 'gs')) AS content FROM conversations WHERE role IN ('user', 'assistant') AND trim(regexp_replace(text, '<relevant-memories>.*?</relevant-memories>', '', 'gs')) <> ''")
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.trim(F.regexp_replace("text", r"(?s)<relevant-memories>.*?</relevant-memories>", ""))
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).withColumn("content", content).where("content <> ''").select("conv_id", "turn", "role", "content")


@R.query("SELECT conv_id, turn, role, max(text) AS text FROM (SELECT * FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 2 = 0) GROUP BY ALL")
def turn_sink_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written twice: the key (conversation, turn, role) keeps one."""
    turns = table(spark, sf_dir, "conversations")
    return turns.unionByName(turns.where("conv_id % 2 = 0")).groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))


@R.query("WITH t AS (SELECT event_id, ts, event_type, value FROM events), m AS (SELECT max(ts) AS m FROM events) SELECT event_id, event_type FROM t, m WHERE NOT (ts < m - INTERVAL 10 DAY AND event_type NOT IN ('purchase', 'signup'))")
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old traces go, but never the rated or answered ones."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    last = events.agg(F.max("ts").alias("m"))
    old = (F.col("ts") < F.col("m") - F.expr("INTERVAL 10 DAYS")) & ~F.col("event_type").isin("purchase", "signup")
    return events.join(F.broadcast(last), F.lit(True)).where(~old).select("event_id", "event_type")


@R.query(f"WITH {MEMORY_SQL} SELECT id, scope FROM mem WHERE scope = 'user' OR scope IS NULL OR (scope = 'session' AND session_id = 's3')")
def scope_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(pr.in_scope("default", session_id="s3")).select("id", "scope")


@R.query(f"WITH {MEMORY_SQL} SELECT id, scope FROM mem WHERE scope = 'session' AND session_id = 's3'")
def scope_strict_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(pr.in_scope("session", session_id="s3")).select("id", "scope")


@R.query(f"WITH {MEMORY_SQL} SELECT id, path FROM mem WHERE (path = '/repo/1' OR path IS NULL) AND {VALID}")
def path_and_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).where(pr.on_path("/repo/1") & pr.is_valid(now())).select("id", "path")


@R.query(f"WITH {MEMORY_SQL} SELECT id, tier, confidence FROM mem WHERE created_at >= TIMESTAMP '2024-04-01' AND tier = 'durable' AND coalesce(confidence, -1) >= 0.6 AND category IN ('events', 'cases')")
def soft_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).where(pr.soft("2024-04-01", "durable", 0.6, ["events", "cases"])).select("id", "tier", "confidence")


NQ = r"trim(regexp_replace(regexp_replace(text, '(?i)^Cron\s+job\s*\([^)]*\):\s*', ''), '^\[\d{4}-\d{2}-\d{2}T[^\]]*\]\s*', ''))"


@R.query(f"SELECT conv_id, turn, CASE WHEN {rx(NQ, pr.FORCE_RETRIEVE)} THEN false WHEN length({NQ}) < 5 THEN true WHEN {rx(NQ, pr.SKIP_RETRIEVE)} THEN true ELSE length({NQ}) < CASE WHEN regexp_matches({NQ}, '[一-鿿぀-ヿ가-힯]') THEN 6 ELSE 15 END END AS skip FROM conversations")
def skip_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pr.skips_retrieval(F.col("text")).alias("skip"))


@R.query(f"SELECT conv_id, turn, length(trim(text)) < 10 OR {rx('trim(text)', pr.NOISE_FACTS)} AS noise FROM conversations")
def noise_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pr.is_noise(F.col("text")).alias("noise"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, category FROM mem WHERE coalesce(confidence, 0) >= greatest(0.7, CASE category WHEN 'profile' THEN 0.7 WHEN 'preferences' THEN 0.7 WHEN 'entities' THEN 0.85 WHEN 'events' THEN 0.85 WHEN 'cases' THEN 0.8 WHEN 'patterns' THEN 0.8 ELSE CASE WHEN category IS NULL THEN 0.7 ELSE 0.95 END END)")
def confidence_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ("labels",)).where(F.coalesce("confidence", F.lit(0.0)) >= pr.confidence_floor()).select("id", "category")


@R.query(f"SELECT item_id, (trim(text) <> '') AND (contains(trim(text), '?') OR {rx('trim(text)', pr.EXACT_QUERY)}) AND ({rx('trim(text)', pr.EXACT_VALUE)} OR {rx('trim(text)', pr.EXACT_QUERY)}) AS exact, {rx('text', pr.EXACT_VALUE)} AS has_value FROM benchmark")
def exact_qa_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", pr.exact_intent(F.col("text")).alias("exact"), pr.exact_value_signal(F.col("text")).alias("has_value"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, {' OR '.join(f'contains(lower(text), {chr(39)}{c}{chr(39)})' for c in pr.HANDOFF_CUES)} AS handoff FROM mem")
def handoff_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", pr.has_handoff_cue(F.col("text")).alias("handoff"))


@R.query("WITH h AS (SELECT user_id, event_id, value / 200 AS score FROM events), g AS (SELECT user_id FROM h GROUP BY user_id HAVING max(score) >= 0.9) SELECT user_id, event_id, round(score, 6) AS score FROM h WHERE user_id IN (SELECT user_id FROM g)")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 200).alias("score"))
    return pr.relevance_gate(hits, ["user_id"], 0.9).withColumn("score", F.round("score", 6))


COS = "(list_sum(list_transform(list_zip(m.embedding, p.embedding), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(m.embedding, lambda x: x * x))) * sqrt(list_sum(list_transform(p.embedding, lambda x: x * x)))))"


@R.query(f"WITH {MEMORY_SQL} SELECT m.id, round(max({COS}), 6) AS best, coalesce(max({COS}) > 0.92, false) AS noise FROM mem m, (SELECT embedding FROM mem WHERE id < 20 AND embedding IS NOT NULL) p WHERE m.embedding IS NOT NULL GROUP BY m.id")
def noise_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ("embeddings",)).where(F.col("embedding").isNotNull()).select("id", "embedding")
    bank = rows.where("id < 20").select("embedding")  # a prototype bank is a stated, bounded set
    return pr.noise_like(rows, bank).select("id", F.round("best", 6).alias("best"), "noise")


@R.query(f"WITH {MEMORY_SQL} SELECT id, text[:100] AS l0, CASE WHEN regexp_extract(text, '^[\\s\\S]*?[.!?。！？]') = '' THEN text ELSE regexp_extract(text, '^[\\s\\S]*?[.!?。！？]') END AS l1 FROM mem")
def depth_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", sh.at_depth("l0").alias("l0"), sh.at_depth("l1").alias("l1"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, ceil(length(text) / 4)::BIGINT AS tokens FROM mem")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", tx.token_estimate(F.col("text")).alias("tokens"))


@R.query(f"""WITH {MEMORY_SQL}, r AS (SELECT user_id, id, text, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)::INTEGER AS rank FROM mem)
SELECT user_id, '<memories untrusted="true">' || chr(10) || string_agg('- ' || regexp_replace(regexp_replace(replace(text, chr(0), ''), '[\\r\\n]+', ' ', 'g'), '^(?:> ?)+', ''), chr(10) ORDER BY rank) || chr(10) || '</memories>' AS block FROM r WHERE rank <= 5 GROUP BY user_id""")
def untrusted_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.top_per(memory_units(spark, sf_dir, ()).select("user_id", "id", "text", "created_at"), ["user_id"], 5, F.desc("created_at"), F.asc("id"))
    return sh.envelope(rows, ["user_id"])


L1 = "CASE WHEN regexp_extract(text, '^[\\s\\S]*?[.!?。！？]') = '' THEN text ELSE regexp_extract(text, '^[\\s\\S]*?[.!?。！？]') END"


@R.query(f"""WITH {MEMORY_SQL}, r AS (SELECT user_id, id, text, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)::INTEGER AS rank FROM mem),
t AS (SELECT *, ceil(length(text) / 4) AS tf, ceil(length({L1}) / 4) AS t1, ceil(length(text[:100]) / 4) AS t0 FROM r WHERE rank <= 12),
s AS (SELECT *, CASE WHEN sum(tf) OVER g <= 2000 THEN 'full' WHEN sum(t1) OVER g <= 2000 THEN 'l1' ELSE 'l0' END AS depth FROM t WINDOW g AS (PARTITION BY user_id)),
c AS (SELECT *, sum(CASE depth WHEN 'full' THEN tf WHEN 'l1' THEN t1 ELSE t0 END) OVER (PARTITION BY user_id ORDER BY rank)::BIGINT AS spent FROM s)
SELECT user_id, id, rank, depth, spent FROM c WHERE spent <= 2000""")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.top_per(memory_units(spark, sf_dir, ()).select("user_id", "id", "text", "created_at"), ["user_id"], 12, F.desc("created_at"), F.asc("id"))
    return sh.budget_fit(rows, ["user_id"], 2000).select("user_id", "id", "rank", "depth", "spent")


@R.query(f"""WITH {MEMORY_SQL}, r AS (SELECT user_id, id, path, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)::INTEGER AS rank FROM mem),
k AS (SELECT *, CASE WHEN path = '/repo/1' THEN 'exact' WHEN path IS NULL THEN 'none' ELSE 'other' END AS kind FROM r WHERE rank <= 30),
x AS (SELECT *, count(*) FILTER (WHERE kind = 'exact') OVER (PARTITION BY user_id) AS exact, row_number() OVER (PARTITION BY user_id, kind ORDER BY rank) AS place FROM k WHERE kind <> 'other'),
y AS (SELECT user_id, id, rank, row_number() OVER (PARTITION BY user_id ORDER BY kind, rank)::INTEGER AS place FROM x WHERE kind = 'exact' OR exact * 2 < 8 OR place = 1)
SELECT user_id, id, place FROM y WHERE place <= 8""")
def path_quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.top_per(memory_units(spark, sf_dir, ()).select("user_id", "id", "path", "created_at"), ["user_id"], 30, F.desc("created_at"), F.asc("id"))
    return sh.path_quota(rows, ["user_id"], "/repo/1", 8).select("user_id", "id", "place")


@R.query(f"WITH {MEMORY_SQL} SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[email]', 'g'), '\\b(AKIA[A-Z0-9]{{16}}|[0-9a-f]{{32,}})\\b', '[key]', 'g'), '/(home|Users)/[^/\\s]+', '~', 'g') AS text FROM mem")
def export_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", sh.redacted(F.col("text")).alias("text"))


@R.query(f"WITH {MEMORY_SQL} SELECT created_at::DATE AS day, category AS folder, count(*) AS notes, sum(length(text))::BIGINT AS chars FROM mem WHERE {ACTIVE} GROUP BY ALL")
def vault_daily_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregation behind a vault export: notes a day and folder."""
    rows = memory_units(spark, sf_dir, ()).where(pr.is_active())
    return rows.groupBy(F.to_date("created_at").alias("day"), F.col("category").alias("folder")).agg(F.count("*").alias("notes"), F.sum(F.length("text")).alias("chars"))
