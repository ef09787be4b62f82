"""Re-ranking and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import ranking as rk
from palimpsest.operators import retrieval as rt
from palimpsest.plans.registry import Registry
from palimpsest.plans.scans import rx
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()

#: Every tenant is a query; its hits are its memories, scored by a fixed rule.
HITS_SQL = f"{MEMORY_SQL}, hits AS (SELECT *, ((id * 37) % 101) / 100.0::DOUBLE AS score FROM mem)"
PRIMARY = ("current_status", "session_handoff", "recent_work")
PRIMARY_SQL = "('current_status', 'session_handoff', 'recent_work')"
ROLES_SQL = "('project_state', 'current_status', 'session_handoff', 'recent_work', 'debugging_active', 'planning_active')"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).withColumn("score", (F.col("id") * 37 % 101) / 100.0)


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), *more)


def case(column: str, pairs: list[tuple[str, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in pairs) + f" ELSE '{last}' END"


@R.query(f"SELECT conv_id, turn, i AS intent, CASE i {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in rk.LANES.items())} ELSE 'unknown_mixed' END AS lane FROM (SELECT conv_id, turn, {case('text', list(rk.INTENTS), 'fact')} AS i FROM conversations)")
def intent_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", rk.intent(F.col("text")).alias("intent"))
    return turns.withColumn("lane", rk.lane(F.col("intent")))


@R.query(f"WITH {HITS_SQL} SELECT id, round(score * CASE WHEN path IS NULL THEN 0.7 ELSE 1.0 END, 6) AS score FROM hits")
def null_path_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rk.null_path_penalty(hits(spark, sf_dir), "/repo/1"))


@R.query(f"WITH {HITS_SQL} SELECT id, round(score * CASE WHEN category IN ('events', 'entities') THEN 1.15 ELSE 1.0 END, 6) AS score FROM hits")
def category_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rk.category_boost(hits(spark, sf_dir), "event"))


@R.query(f"WITH {HITS_SQL} SELECT id, round(score * CASE WHEN {rx('text', rk.HISTORIC)} OR id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0.4 ELSE 1.0 END, 6) AS score FROM hits")
def stale_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return scored(rk.stale_demotion(hits(spark, sf_dir), learned))


@R.query(f"WITH {HITS_SQL} SELECT id, round(score * CASE WHEN created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 0.5 ELSE 1.0 END, 6) AS score FROM hits")
def status_recency_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rk.status_recency(hits(spark, sf_dir), now()))


COUNT = lambda patterns: "(" + " + ".join(f"regexp_matches(text, '{p}')::INTEGER" for p in patterns) + ")"
STATUS_SQL, NOISE_SQL = f"least(1.0, {COUNT(rk.STATUS_SIGNALS)} / 3.0)", f"least(1.0, {COUNT(rk.NOISE_SIGNALS)} / 3.0)"
HISTORIC_SQL = f"CASE WHEN {COUNT(rk.STATUS_SIGNALS)} > 0 THEN 0.0 WHEN {rx('text', rk.HISTORIC)} THEN 1.0 ELSE 0.0 END"
AGE_SQL = f"((epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600.0)"
SCOPE_SQL = "CASE WHEN path = '/repo/1' THEN 1.0 WHEN path IS NULL THEN 0.35 ELSE 0.0 END"


@R.query(f"WITH {HITS_SQL} SELECT id, round({STATUS_SQL}, 6) AS status, round({NOISE_SQL}, 6) AS noise, {HISTORIC_SQL}::DOUBLE AS historic, {SCOPE_SQL}::DOUBLE AS scope FROM hits")
def status_sub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rk.signals(F.col("text"))
    return hits(spark, sf_dir).select("id", F.round(s["status"], 6).alias("status"), F.round(s["noise"], 6).alias("noise"), s["historic"].alias("historic"), rk.scope_match("/repo/1").alias("scope"))


@R.query(f"""WITH {HITS_SQL}, b AS (SELECT *, greatest(max(score) OVER (PARTITION BY user_id), 1.0) AS best FROM hits)
SELECT id, round(0.30 * score / best + 0.18 * pow(0.5, {AGE_SQL} / 168.0) + 0.15 * {STATUS_SQL} + 0.10 * {SCOPE_SQL} + 0.15 * CASE WHEN memory_role IN {ROLES_SQL} THEN 1.0 ELSE 0.4 END
  + 0.05 * CASE WHEN invalid_at IS NOT NULL THEN 0.0 ELSE 1.0 END + 0.07 * CASE WHEN {COUNT(rk.STATUS_SIGNALS)} > 0 THEN 1.0 ELSE 0.0 END - 0.15 * {NOISE_SQL} - 0.05 * {HISTORIC_SQL} + 1e-9, 6) AS score FROM b""")
def current_status_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the 1e-9 keeps exact halves of the last digit from depending on the order of a sum
    return scored(rk.current_status(hits(spark, sf_dir), ["user_id"], now(), "/repo/1").withColumn("score", F.col("score") + 1e-9))


@R.query(f"""WITH {HITS_SQL}, s AS (SELECT *, memory_role IN {ROLES_SQL} OR {COUNT(rk.STATUS_SIGNALS)} > 0 AS strict FROM hits), n AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY session_id) AS k FROM s)
SELECT id, session_id, CASE WHEN k >= 2 THEN 'strict' ELSE 'fallback' END AS mode FROM n WHERE CASE WHEN k >= 2 THEN strict ELSE memory_role <> 'operational_noise' END""")
def current_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.status_filter(hits(spark, sf_dir), ["session_id"]).select("id", "session_id", "mode")


@R.query(f"""WITH {HITS_SQL}, b AS (SELECT *, greatest(max(score) OVER (PARTITION BY user_id), 1.0) AS best FROM hits)
SELECT id, round(0.42 * score / best + 0.20 * CASE WHEN memory_role IN {PRIMARY_SQL} THEN 1.0 ELSE 0.3 END + 0.13 * {SCOPE_SQL} + 0.10 * pow(0.5, {AGE_SQL} / 336.0) + 0.15 * coalesce(active, true)::INTEGER, 6) AS score FROM b""")
def policy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rk.policy_score(hits(spark, sf_dir), ["user_id"], now(), PRIMARY, "/repo/1"))


@R.query(f"""WITH {HITS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, memory_role ORDER BY score DESC, id) AS place FROM hits WHERE memory_role NOT IN ('operational_noise', 'admin_process', 'deploy_ops'))
SELECT id, user_id, memory_role FROM p WHERE place <= CASE memory_role WHEN 'current_status' THEN 1 ELSE 1000000 END""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.admit(hits(spark, sf_dir), ["user_id"], ("operational_noise", "admin_process", "deploy_ops"), {"current_status": 1}).select("id", "user_id", "memory_role")


@R.query(f"""WITH {HITS_SQL}, l AS (SELECT *, (memory_role IN {PRIMARY_SQL} AND row_number() OVER (PARTITION BY user_id, memory_role IN {PRIMARY_SQL} ORDER BY score DESC, id) = 1)::INTEGER AS lead FROM hits),
r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY lead DESC, score DESC, id)::INTEGER AS rank FROM l) SELECT * FROM r WHERE rank <= 10""")
def primary_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.promote_primary(hits(spark, sf_dir), ["user_id"], PRIMARY).where("rank <= 10").select("user_id", "id", "rank")


GOALS, TOPICS, WEIGHTS = ["the", "passage", "that", "language"], {"passage": 0.8, "the": 0.4}, {"recent_work": 0.9, "current_status": 0.6}
FIT_SQL = """least(greatest(0.6 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), ['the', 'passage', 'that', 'language'])) / 4
  + 0.25 * (CASE WHEN contains(lower(text), 'passage') THEN 0.8 ELSE 0.0 END + CASE WHEN contains(lower(text), 'the') THEN 0.4 ELSE 0.0 END) / 2
  + 0.15 * CASE memory_role WHEN 'recent_work' THEN 0.9 WHEN 'current_status' THEN 0.6 ELSE 0.0 END, 0.0), 1.0)"""


def fit() -> Column:
    return rk.frame_fit(F.col("text"), F.col("memory_role"), GOALS, TOPICS, WEIGHTS)


@R.query(f"WITH {HITS_SQL}, f AS (SELECT id, {FIT_SQL} AS fit FROM hits) SELECT id, round(fit, 6) AS fit, round(1 / (1 + exp(-6 * (fit - 0.5))), 6) AS calibrated FROM f")
def context_frame_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("id", fit().alias("fit")).select("id", F.round("fit", 6).alias("fit"), F.round(rk.calibrated(F.col("fit")), 6).alias("calibrated"))


RANKED_SQL = f"{HITS_SQL}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id)::INTEGER AS rank FROM hits) WHERE rank <= 10)"
GATE_SQL = "gates AS (SELECT user_id, CASE WHEN gap IS NULL OR gap <= 0.005 THEN 1.0 WHEN gap >= 0.02 THEN 0.0 ELSE (0.02 - gap) / 0.015 END AS gate FROM (SELECT user_id, greatest(max(score) FILTER (WHERE rank = 5) - max(score) FILTER (WHERE rank = 6), 0.0) AS gap FROM ranked GROUP BY user_id))"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.top_per(hits(spark, sf_dir), ["user_id"], 10, F.desc("score"), F.asc("id"))


@R.query(f"WITH {RANKED_SQL}, {GATE_SQL} SELECT user_id, round(gate, 6) AS gate FROM gates")
def ambiguity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.ambiguity_gate(ranked(spark, sf_dir), ["user_id"], 5, 0.005).select("user_id", F.round("gate", 6).alias("gate"))


@R.query(f"WITH {RANKED_SQL}, {GATE_SQL}, b AS (SELECT user_id, id, score + CASE WHEN rank <= 5 THEN gate * 0.1 * {FIT_SQL} * 0.25 ELSE 0.0 END AS score FROM ranked JOIN gates USING (user_id)) SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id)::INTEGER AS rank, round(score, 6) AS score FROM b")
def frame_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.frame_rerank(ranked(spark, sf_dir), ["user_id"], fit(), 5, 0.005).select("user_id", "id", "rank", F.round("score", 6).alias("score"))


@R.query("SELECT o_custkey, o_orderkey, o_orderstatus, n_revisions FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS n_revisions FROM orders) WHERE k = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("n_revisions", F.count("*").over(Window.partitionBy("o_custkey")))
    return rk.latest_state(orders, F.col("o_custkey"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", "n_revisions")


@R.query(f"WITH {RANKED_SQL} SELECT id FROM ranked WHERE path IS NOT NULL AND NOT {rx('text', rk.HISTORIC)}")
def access_tracked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.text import any_match

    return ranked(spark, sf_dir).where(F.col("path").isNotNull() & ~any_match(F.col("text"), rk.HISTORIC)).select("id")


@R.query(f"""WITH {RANKED_SQL}, p AS (SELECT user_id, id, score * CASE WHEN path IS NULL THEN 0.7 ELSE 1.0 END * CASE WHEN category IN ('events', 'entities') THEN 1.15 ELSE 1.0 END * CASE WHEN created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 0.5 ELSE 1.0 END AS score FROM ranked)
SELECT user_id, id, round(score, 6) AS score FROM p""")
def ranking_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"null_path": lambda d: rk.null_path_penalty(d, "/repo/1"), "category": lambda d: rk.category_boost(d, "event"), "recency": lambda d: rk.status_recency(d, now()), "stale": lambda d: d.limit(0)}
    done = rk.run_plan(ranked(spark, sf_dir), stages, ["null_path", "category", "stale", "recency"], frozenset({"stale"}))
    return done.select("user_id", "id", F.round("score", 6).alias("score"))
