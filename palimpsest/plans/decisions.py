"""Decisions about writes and hits, each with its SQL twin. The lists in the SQL are written out, not shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import decisions as dc
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units, table

R = Registry()
PAIR_SQL = f"{MEMORY_SQL}, p AS (SELECT n.*, o.text AS old_text, o.tier AS old_tier, o.created_at AS old_created, o.category AS old_category, o.session_id AS old_session FROM mem n LEFT JOIN mem o ON o.id = n.id - 20)"


def norm_sql(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '[ \t\r\n\f]+', ' ', 'g'))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record beside the one twenty before it."""
    rows = memory_units(spark, sf_dir, ())
    old = rows.select((F.col("id") + 20).alias("id"), F.col("text").alias("old_text"), F.col("tier").alias("old_tier"), F.col("created_at").alias("old_created"), F.col("category").alias("old_category"), F.col("session_id").alias("old_session"))
    return rows.join(old, "id", "left")


@R.query(rf"""WITH {MEMORY_SQL}, t AS (SELECT id, text, CASE WHEN id % 3 = 0 THEN memory_role END AS role FROM mem)
SELECT id, CASE WHEN role <> 'project_state' THEN role
  WHEN regexp_matches(text, '\bsession handoff\b|\bresume here\b|\bnext time\b', 'i') THEN 'session_handoff'
  WHEN regexp_matches(text, '\bdebugging\b|\bfailing test\b|\btest failure\b|\bblocked\b', 'i') THEN 'debugging_active'
  WHEN regexp_matches(text, '\bcurrent status\b|\bcurrently\b', 'i') THEN 'current_status'
  WHEN regexp_matches(text, '\bplan\b|\bnext step\b|\bmilestone\b', 'i') THEN 'planning_active'
  WHEN regexp_matches(text, '\barchitecture\b|\binvariant\b|\bpipeline\b|\bdata flow\b|\bpostProcessRecallResults\b', 'i') THEN 'architecture_reference'
  WHEN regexp_matches(text, '\bscout\b|\bresearch\b', 'i') THEN 'research_context'
  WHEN regexp_matches(text, '\bdeploy(?:ed)?\b|\bpm2\b|\bDigitalOcean\b|\bport 7700\b', 'i') THEN 'deploy_ops'
  WHEN regexp_matches(text, '\badmin(?:istrative)?\b|\bworkflow\b|\bbd prime\b|\bpush git changes\b', 'i') THEN 'admin_process'
  WHEN regexp_matches(text, '\bbuilder brief\b|\btask initialization\b|\bhousekeeping\b|\bmaintenance\b|\btsconfig\.json\b|\bnpx\s+tsx\b|\bscript runs?\b', 'i') THEN 'operational_noise'
  ELSE 'recent_work' END AS kind FROM t""")
def memory_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third record has a stored role."""
    role = F.when(F.col("id") % 3 == 0, F.col("memory_role"))
    return memory_units(spark, sf_dir, ()).select("id", dc.memory_kind(F.col("text"), role).alias("kind"))


@R.query(r"""WITH t AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations)
SELECT conv_id, turn, role, regexp_matches(t, '\breplac(?:e|es|ed|ing)\b|\bno longer\b|\binstead of\b|\bmigrat(?:e|es|ed|ing)\b|\bswitch(?:ed|ing)?\s+(?:\w+ly\s+)?(?:to|from|off|over|away)\b|\bmoved?\s+(?:\w+ly\s+)?(?:to|off|from|over|away)\b|\bmoved?\s+on\s+to\b|\btransition(?:ed|ing|s)?\s+(?:\w+ly\s+)?(?:to|from|away)\b|\bis now\b|\bas of\b|\btook over\b|\btaking over\b|\bstepped down\b|\bthe new\b|\b(?:updated|changed|upgraded)\s+(?:to|from)\b')
  OR regexp_matches(regexp_replace(t, '\b(dropped|ditched)\s+(the|a|an)\b', ' ', 'g'), '\b(?:dropped|ditched)\s+(?:\w+\s+){0,3}(?:for\b|in favor of\b)') AS cue FROM t""")
def currentness_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", dc.currentness_cue(F.col("text")).alias("cue"))


@R.query(rf"""WITH {PAIR_SQL}, q AS (SELECT *, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'soon' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS tm,
  CASE WHEN id % 5 <> 0 THEN strftime(old_created, '%Y-%m-%d %H:%M:%S') END AS old_at, CASE WHEN id % 7 <> 0 THEN tier END AS new_tier FROM p)
SELECT id, CASE WHEN old_tier = 'durable' AND new_tier IS DISTINCT FROM 'durable' THEN CASE WHEN new_tier = 'ephemeral' THEN 'ephemeral-over-durable'
    WHEN regexp_matches(lower(text), '\bfor now\b|\bfor the moment\b|\bfor the time being\b|\btemporarily\b|\bat the moment\b|\bright now\b|\bthis (?:week|month|morning|afternoon|evening|sprint)\b|\btoday\b|\btonight\b') THEN 'transient-over-durable' END END AS durability,
  CASE WHEN tm = 'soon' THEN 'invalid-incoming-validAt' WHEN old_at IS NULL THEN 'invalid-candidate-time'
    WHEN (CASE WHEN tm IS NULL OR tm = '' THEN TIMESTAMP '{NOW}' ELSE try_cast(tm AS TIMESTAMP) END) < try_cast(old_at AS TIMESTAMP) THEN 'older-incoming' END AS ordering FROM q""")
def supersede_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record against the one twenty before it; some times are absent, empty or unreadable."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    at = F.when(F.col("id") % 6 == 1, "").when(F.col("id") % 6 == 2, "soon").when(F.col("id") % 6 > 2, shown(F.col("created_at")))
    old_at = F.when(F.col("id") % 5 != 0, shown(F.col("old_created")))
    tier = F.when(F.col("id") % 7 != 0, F.col("tier"))
    durable, ordered = dc.durability_reason(F.col("old_tier"), tier, F.col("text")), dc.ordering_reason(old_at, at, F.lit(NOW).cast("timestamp"))
    return pairs(spark, sf_dir).select("id", durable.alias("durability"), ordered.alias("ordering"))


@R.query(f"""WITH {PAIR_SQL}, q AS (SELECT id, CASE WHEN id % 4 <> 0 THEN category END AS fact, session_id AS subject, {norm_sql("old_text")} AS o, {norm_sql("CASE WHEN id % 5 = 1 THEN '  ' || replace(old_text, ' ', chr(9)) WHEN id % 5 = 2 THEN old_text || ' more' ELSE text END")} AS n FROM p)
SELECT id, CASE WHEN fact IS NULL OR o IS NULL THEN 'create' WHEN o = n THEN 'skip' WHEN contains(o, n) OR contains(n, o) THEN 'merge-update' ELSE 'supersede' END AS outcome FROM q""")
def overlay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record twenty before is the overlay's; some writes repeat it with other white space or add to it."""
    text = F.when(F.col("id") % 5 == 1, F.concat(F.lit("  "), F.replace(F.col("old_text"), F.lit(" "), F.lit("\t")))).when(F.col("id") % 5 == 2, F.concat("old_text", F.lit(" more"))).otherwise(F.col("text"))
    outcome = dc.overlay_outcome(F.when(F.col("id") % 4 != 0, F.col("category")), F.col("session_id"), F.col("old_text"), text)
    return pairs(spark, sf_dir).select("id", outcome.alias("outcome"))


@R.query(f"""WITH {MEMORY_SQL}, d AS (SELECT id, CASE WHEN id % 14 <> 0 THEN active END AS active, ((id * 37) % 101) / 100.0 AS score, tier AS text FROM mem WHERE id % 2 = 0), o AS (SELECT id, category AS text FROM mem WHERE id % 3 = 0 UNION ALL SELECT id + 1000000000, category FROM mem WHERE id % 100 = 3),
j AS (SELECT coalesce(d.id, o.id) AS id, d.id IS NOT NULL AS found, o.id IS NOT NULL AND coalesce(d.active, m.active, false) AS wins, d.score, d.text AS hit_text, o.text AS new_text FROM d FULL JOIN o ON o.id = d.id LEFT JOIN mem m ON m.id = o.id)
SELECT id, coalesce(score, 0)::DOUBLE AS score, CASE WHEN wins THEN new_text ELSE hit_text END AS text, wins AS from_overlay FROM j WHERE found OR wins""")
def overlay_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even records are the durable hits, every third one has an overlay entry; some entries have no record."""
    rows = memory_units(spark, sf_dir, ())
    durable = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 14 != 0, F.col("active")).alias("active"), (F.col("id") * 37 % 101 / 100.0).alias("score"), F.col("tier").alias("text"))
    overlay = rows.where("id % 3 = 0").select("id", F.col("category").alias("text")).union(rows.where("id % 100 = 3").select(F.col("id") + 1000000000, "category"))
    return dc.overlay_merge(durable, overlay, rows.select("id", "active"))


@R.query("""WITH h AS (SELECT doc_id AS id, ((doc_id * 37) % 101) / 100.0 AS score, CASE WHEN doc_id % 4 <> 0 THEN ((doc_id * 53) % 101) / 100.0 END AS rerank, doc_id % 6 = 0 AS preserve FROM documents)
SELECT id, (CASE WHEN rerank >= 0.3 THEN rerank ELSE greatest(coalesce(rerank, 0), 0.35) END)::DOUBLE AS score FROM h WHERE coalesce(rerank >= 0.3, false) OR preserve""")
def rerank_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    hits = table(spark, sf_dir, "documents").select(i.alias("id"), (i * 37 % 101 / 100.0).alias("score"), F.when(i % 4 != 0, i * 53 % 101 / 100.0).alias("rerank"), (i % 6 == 0).alias("preserve"))
    return dc.reranked(hits, 0.3, 0.35).select("id", "score")


@R.query(f"""WITH {MEMORY_SQL}, m AS (SELECT id // 5 AS cluster, id, text, confidence, category FROM mem), s AS (SELECT cluster, id, string_split(text, chr(10)) AS ls FROM m), l AS (SELECT cluster, id, generate_subscripts(ls, 1) AS pos, trim(unnest(ls)) AS line FROM s),
f AS (SELECT cluster, id, pos, line, row_number() OVER (PARTITION BY cluster, lower(line) ORDER BY id, pos) AS k FROM l WHERE line <> ''), t AS (SELECT cluster, string_agg(line, chr(10) ORDER BY id, pos) AS text FROM f WHERE k = 1 GROUP BY cluster),
v AS (SELECT cluster, category, count(*) AS n, min(id) AS first FROM m GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS k FROM v)
SELECT m.cluster, max(confidence) AS confidence, count(*) AS members, any_value(c.category) AS category, sha256(any_value(t.text)) AS text_sha FROM m JOIN c ON c.cluster = m.cluster AND c.k = 1 LEFT JOIN t ON t.cluster = m.cluster GROUP BY m.cluster""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records in a row are one cluster; the text is compared by its hash."""
    members = memory_units(spark, sf_dir, ("labels",)).select(F.floor(F.col("id") / 5).alias("cluster"), "id", "text", "confidence", "category")
    return dc.merged_entries(members).select("cluster", "confidence", "members", "category", F.sha2("text", 256).alias("text_sha"))


@R.query(rf"""WITH {MEMORY_SQL}, f AS (SELECT id, CASE WHEN user_id IS NULL THEN '\x00'::BLOB ELSE '\x01'::BLOB || encode(to_json(user_id)::VARCHAR) END AS a, CASE WHEN path IS NULL THEN '\x00'::BLOB ELSE '\x01'::BLOB || encode(to_json(path)::VARCHAR) END AS b FROM mem) SELECT id, sha256(a || b) AS hash FROM f""")
def boundary_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", dc.boundary_hash(F.col("user_id"), F.col("path")).alias("hash"))


@R.query("""WITH t AS (SELECT role, conv_id, CASE WHEN role = 'user' THEN ceil(length(text) / 4)::BIGINT END AS p, CASE WHEN role <> 'user' THEN ceil(length(text) / 4)::BIGINT END AS c, CASE conv_id % 3 WHEN 0 THEN 0.001 * turn WHEN 1 THEN -1.0 END AS billed FROM conversations),
e AS (SELECT role, billed, CASE WHEN coalesce(p, 0) > 0 OR coalesce(c, 0) > 0 THEN coalesce(p, 0) / 1e6 * 3.0 + coalesce(c, 0) / 1e6 * 15.0 END AS estimated FROM t)
SELECT role, round(sum(CASE WHEN billed >= 0 THEN billed ELSE coalesce(estimated, 0) END), 6)::DOUBLE AS usd, count(*) * 3 * 2 AS planned FROM e GROUP BY role""")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users are prompts, all others completions; planned are three candidates, twice each."""
    tokens = F.ceil(F.length("text") / 4)
    user = F.col("role") == "user"
    estimated = dc.cost(F.when(user, tokens), F.when(~user, tokens), 3.0, 15.0)
    billed = F.when(F.col("conv_id") % 3 == 0, 0.001 * F.col("turn")).when(F.col("conv_id") % 3 == 1, -1.0)
    used = table(spark, sf_dir, "conversations").select("role", dc.billed_or_estimated(billed, estimated).alias("usd"))
    return used.groupBy("role").agg(F.round(F.sum("usd"), 6).alias("usd"), (F.count("*") * 3 * 2).alias("planned"))


@R.query(rf"""WITH {MEMORY_SQL}, r AS (SELECT id, text, CASE WHEN id % 11 <> 0 THEN category ELSE 'other' END AS cat, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN NULL WHEN 2 THEN 'nan' ELSE confidence::VARCHAR END AS conf FROM mem), f AS (SELECT id, text, CASE WHEN cat = 'other' THEN 'cases' ELSE cat END AS category, CASE WHEN id % 4 = 3 THEN coalesce(try_cast(conf AS DOUBLE), 0.7) ELSE 0.7 END AS confidence FROM r)
SELECT id, left(text, 100) AS l0, '- ' || left(text, 100) AS l1, category, confidence, CASE WHEN category = 'profile' AND regexp_matches(text, '\b(name is|called|goes by|known as|my name)\b', 'i') THEN 'profile:name' WHEN category = 'preferences' AND regexp_matches(text, '\b(address me|call me|refer to me|don''t call me)\b', 'i') THEN 'preferences:addressing'
  WHEN category = 'profile' AND regexp_matches(text, '\b(i am a|i''m a|i work as|my role|my job)\b', 'i') THEN 'profile:role' WHEN category = 'preferences' AND regexp_matches(text, '\b(i prefer|i use|my preferred language|i code in)\b', 'i') THEN 'preferences:language' END AS identity_key FROM f""")
def fact_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("id"), F.lit(None).cast("string")
    conf = F.when(i % 4 == 0, "high").when(i % 4 == 2, "nan").when(i % 4 == 3, F.col("confidence").cast("string"))
    raw = memory_units(spark, sf_dir, ("labels",)).select("id", F.col("text").alias("l2"), none.alias("l0"), none.alias("l1"), F.when(i % 11 != 0, F.col("category")).otherwise("other").alias("category"), conf.alias("confidence"))
    return dc.normalised_facts(raw).select("id", "l0", "l1", "category", "confidence", "identity_key")


@R.query(f"""WITH {PAIR_SQL}, q AS (SELECT id, old_category AS s1, old_tier AS p1, old_session AS v1, CASE WHEN id % 3 = 0 THEN upper(old_category) || '  ' ELSE category END AS s2, CASE WHEN id % 7 = 0 THEN 'a|b' ELSE old_tier END AS p2, CASE WHEN id % 5 = 0 THEN NULL ELSE ' ' || session_id END AS v2 FROM p)
SELECT id, CASE WHEN s1 IS NOT NULL AND v2 IS NOT NULL AND p2 <> 'a|b' AND {norm_sql("s1")} = {norm_sql("s2")} AND p1 = p2 AND trim(v1) = trim(v2) THEN 'retain' ELSE 'clear' END AS action FROM q""")
def atomic_fact_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of category, tier and session; some have another case, a bar, or no value."""
    i = F.col("id")
    stored = (F.col("old_category"), F.col("old_tier"), F.col("old_session"))
    new = (F.when(i % 3 == 0, F.concat(F.upper("old_category"), F.lit("  "))).otherwise(F.col("category")), F.when(i % 7 == 0, "a|b").otherwise(F.col("old_tier")), F.when(i % 5 != 0, F.concat(F.lit(" "), F.col("session_id"))))
    return pairs(spark, sf_dir).select("id", dc.atomic_action(stored, new).alias("action"))


@R.query("""WITH g AS (SELECT DISTINCT user_id AS gap FROM events), c AS (SELECT user_id AS gap, max(ts) AS tm, bool_or(event_type = 'purchase') AS done FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT gap, CASE WHEN done THEN 'resolved' ELSE 'open' END AS status, tm AS reported_at FROM g LEFT JOIN c USING (gap)""")
def gap_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error reports a user's gap, a purchase resolves it."""
    events = table(spark, sf_dir, "events")
    gaps = events.select(F.col("user_id").alias("gap")).distinct().withColumns({"status": F.lit("open"), "reported_at": F.lit(None).cast("timestamp")})
    done = F.when(F.max(F.col("event_type") == "purchase"), "resolved")
    changes = events.where("event_type in ('purchase', 'error')").groupBy(F.col("user_id").alias("gap")).agg(done.alias("new_status"), F.max("ts").alias("new_reported"))
    return dc.stamped(gaps, changes)


@R.query("""WITH m AS (SELECT unnest(['the', 'data', 'of', 'zebra']) AS mention), h AS (SELECT mention, conv_id, turn, role, text, row_number() OVER (PARTITION BY mention ORDER BY conv_id, turn, role, text) AS k FROM conversations JOIN m ON contains(lower(text), mention))
SELECT mention, k::INTEGER AS rank, conv_id AS session, turn FROM h WHERE k <= 3""")
def mention_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.mentioned_in(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session"), ["the", "Data", "of", "zebra"])


@R.query(f"""WITH {MEMORY_SQL}, s AS (SELECT user_id, created_at AS tm, quality IS NOT NULL OR created_at < TIMESTAMP '{NOW}' - INTERVAL 1000 HOUR AS swept FROM mem), f AS (SELECT user_id, min(tm) AS open_from FROM s WHERE NOT swept GROUP BY user_id)
SELECT s.user_id, max(CASE WHEN open_from IS NULL OR tm < open_from THEN tm END) AS watermark FROM s LEFT JOIN f ON f.user_id = s.user_id GROUP BY s.user_id""")
def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swept are records that have a label, and old ones."""
    old = F.col("created_at") < F.expr(f"timestamp '{NOW}' - interval 1000 hours")
    rows = memory_units(spark, sf_dir, ("labels",)).select("user_id", F.col("created_at").alias("at"), (F.col("quality").isNotNull() | old).alias("swept"))
    return dc.tie_safe_watermark(rows, ["user_id"])


@R.query("SELECT CASE WHEN l_suppkey % 4 = 1 THEN l_suppkey + 1 ELSE l_suppkey END AS src, l_partkey AS dst, max(l_quantity) AS confidence FROM lineitem GROUP BY ALL")
def promoted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth supplier is promoted to the next one; a part that both supply keeps one edge."""
    line = table(spark, sf_dir, "lineitem")
    promoted = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1).alias("new"))
    return dc.remapped(line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("confidence")), promoted)


@R.query("""WITH s AS (SELECT user_id AS key, count(*) % 5 AS version, max(event_type) AS value FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), w AS (SELECT user_id AS key, CASE WHEN user_id % 2 = 0 THEN count(*) % 5 END AS expected, min(event_type) AS new_value FROM events GROUP BY user_id),
j AS (SELECT w.key, s.version, s.value, new_value, s.version IS NOT DISTINCT FROM expected AS applied FROM w LEFT JOIN s ON s.key = w.key)
SELECT key, CASE WHEN applied THEN coalesce(version, 0) + 1 ELSE version END AS version, CASE WHEN applied THEN new_value ELSE value END AS value, applied FROM j WHERE version IS NOT NULL OR applied""")
def guarded_state_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose id 3 divides have no state yet; those with an even id expect the right version, the others none."""
    events = table(spark, sf_dir, "events")
    key, version = F.col("user_id").alias("key"), F.count("*") % 5
    states = events.where("user_id % 3 <> 0").groupBy(key).agg(version.alias("version"), F.max("event_type").alias("value"))
    counted = events.groupBy(key).agg(version.alias("expected"), F.min("event_type").alias("new_value"))
    return dc.compare_and_set(states, counted.withColumn("expected", F.when(F.col("key") % 2 == 0, F.col("expected"))))


@R.query(f"""WITH {MEMORY_SQL}, a AS (SELECT id, session_id, CASE id % 4 WHEN 0 THEN scope || ' ' WHEN 1 THEN ' ' WHEN 2 THEN 'odd' END AS asked, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS long_term FROM mem),
s AS (SELECT id, session_id, CASE WHEN trim(asked) IN ('session', 'team', 'global') THEN trim(asked) WHEN trim(asked) <> '' THEN 'user' WHEN long_term = false THEN 'session' ELSE 'user' END AS scope FROM a)
SELECT id, scope, CASE WHEN scope = 'session' THEN session_id END AS session_id FROM s""")
def write_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some writes name a scope, a blank or an unknown one; some say whether they are long-term."""
    i = F.col("id")
    asked = F.when(i % 4 == 0, F.concat("scope", F.lit(" "))).when(i % 4 == 1, " ").when(i % 4 == 2, "odd")
    resolved = dc.write_scope(asked, F.when(i % 3 == 0, True).when(i % 3 == 1, False), F.col("session_id"))
    return memory_units(spark, sf_dir, ()).select("id", *[c.alias(name) for name, c in resolved.items()])
