"""Greedy choices, correction signals and claim contracts, each with its SQL twin. The lists in the SQL are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import choices as ch
from palimpsest.plans import decisions
from palimpsest.plans.arbitration import TOKS
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units

R = Registry()

#: Each record beside the one twenty before it, of the same session, with tags, an occasion or an anchor by fixed rules.
SUFFIX = "CASE {i} % 5 WHEN 0 THEN ' Q' || CAST(1 + {i} {div} 40 % 2 AS {string}) || ' 2024' WHEN 1 THEN ' API-' || CAST({i} {div} 40 % 2 AS {string}) WHEN 2 THEN ' #7' ELSE '' END"
TAGGED_SQL = f"""{MEMORY_SQL}, p AS (SELECT n.id, n.text || {SUFFIX.format(i="n.id", div="//", string="VARCHAR")} AS text, o.text || {SUFFIX.format(i="o.id", div="//", string="VARCHAR")} AS old, n.category, o.category AS old_category, n.user_id, o.user_id AS old_user,
  ['project:' || CASE WHEN n.id % 4 = 0 THEN 'other' ELSE n.session_id END, ' Role:tech_' || n.category, 'person:p' || (n.id // 40 % 3), CASE WHEN n.id % 7 = 0 THEN ' Update' ELSE '' END, 'status:open', 'speaker:user'] AS tags,
  ['project:' || o.session_id, 'role:tech-' || o.category, 'person:p' || (o.id // 40 % 3), 'status:open', 'speaker:user'] AS old_tags FROM mem n JOIN mem o ON o.id = n.id - 20)"""
PLAIN = "list_filter(list_transform({t}, lambda t: lower(trim(t))), lambda t: t <> '')"
SLOTS = "list_distinct(list_transform(list_filter(" + PLAIN + ", lambda t: contains(t, ':') AND NOT starts_with(t, 'speaker:') AND NOT starts_with(t, 'status:')), lambda t: replace(t, '_', '-')))"
SUBJECTS = "list_distinct(list_filter(list_transform(" + PLAIN + ", lambda t: regexp_extract(replace(t, '_', '-'), '^(?:project|subject|person|owner|entity|service|app|repo):(.+)$', 1)), lambda t: t <> ''))"
SIGNALS_SQL = f"""{TAGGED_SQL}, g AS (SELECT *, list_has_any({PLAIN.format(t="tags")}, ['update', 'supersedes_prior', 'invalidation', 'no_longer_true']) AS marker, len(list_intersect({SLOTS.format(t="old_tags")}, {SLOTS.format(t="tags")})) >= 2 AS slot, {SUBJECTS.format(t="old_tags")} AS sa, {SUBJECTS.format(t="tags")} AS sb FROM p),
s AS (SELECT *, len(sa) > 0 AND len(sb) > 0 AND NOT list_has_any(sa, sb) AS conflict, list_has_any(sa, sb) AND len(list_distinct(list_concat(sa, sb))) > len(list_intersect(sa, sb)) AS changed FROM g)"""
OCCASION = "coalesce(nullif(regexp_extract({t}, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), ''), nullif(regexp_extract({t}, '\\bQ[1-4] ?[0-9]{{4}}\\b'), ''), nullif(regexp_extract({t}, '\\b(?:19|20)[0-9]{{2}}\\b'), ''))"
CUES = decisions.R.sql["currentness_cues"].replace("conv_id, turn, role,", "id,").replace("FROM conversations", "FROM p")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ())
    suffix = F.expr(SUFFIX.format(i="id", div="div", string="STRING"))
    person = F.expr("'person:p' || cast(id div 40 % 3 as string)")
    project = F.expr("'project:' || if(id % 4 = 0, 'other', session_id)")
    tags = F.array(project, F.concat(F.lit(" Role:tech_"), "category"), person, F.expr("if(id % 7 = 0, ' Update', '')"), F.lit("status:open"), F.lit("speaker:user"))
    old_tags = F.array(F.concat(F.lit("project:"), "session_id"), F.concat(F.lit("role:tech-"), "category"), person, F.lit("status:open"), F.lit("speaker:user"))
    old = rows.select((F.col("id") + 20).alias("id"), F.concat("text", suffix).alias("old"), F.col("category").alias("old_category"), F.col("user_id").alias("old_user"), old_tags.alias("old_tags"))
    return rows.select("id", F.concat("text", suffix).alias("text"), "category", "user_id", tags.alias("tags")).join(old, "id")


@R.query(f"WITH {SIGNALS_SQL} SELECT id, marker, slot, conflict, changed FROM s")
def correction_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("old_tags"), F.col("tags")
    return tagged(spark, sf_dir).select("id", ch.correction_marker(b).alias("marker"), ch.same_slot(a, b).alias("slot"), ch.conflicting_subjects(a, b).alias("conflict"), ch.changed_subjects(a, b).alias("changed"))


@R.query(rf"""WITH {SIGNALS_SQL}, c AS ({CUES}), x AS (SELECT s.*, c.cue, {OCCASION.format(t="old")} AS was, {OCCASION.format(t="text")} AS now, list_distinct({TOKS("text")}) AS n, {TOKS("old")} AS o FROM s JOIN c ON c.id = s.id),
y AS (SELECT *, len(list_filter(n, lambda z: NOT list_contains(o, z))) AS k, CASE WHEN was LIKE 'Q%' THEN 2 WHEN length(was) = 10 THEN 1 ELSE 3 END AS tw, CASE WHEN now LIKE 'Q%' THEN 2 WHEN length(now) = 10 THEN 1 ELSE 3 END AS tn FROM x)
SELECT id, CASE WHEN conflict AND k >= 3 AND k / greatest(len(n), 1) >= 0.40 THEN 'conflicting-subjects' WHEN was <> now AND tw = tn AND list_has_any(sa, sb) THEN 'distinct-occasion' WHEN slot AND changed AND NOT cue THEN 'ambiguous-slot-change-no-cue' END AS reason FROM y""")
def keep_both_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("id", ch.keep_both_reason(F.col("old"), F.col("text"), F.col("old_tags"), F.col("tags")).alias("reason"))


@R.query(rf"""WITH {TAGGED_SQL}, x AS (SELECT id, list_sort(list_distinct(regexp_extract_all(old, '\b[A-Z]{{2,6}}-[0-9]+\b'))) AS ta, list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z]{{2,6}}-[0-9]+\b'))) AS tb, list_sort(list_distinct(regexp_extract_all(old, '#[0-9]+\b'))) AS ia, list_sort(list_distinct(regexp_extract_all(text, '#[0-9]+\b'))) AS ib,
  CASE WHEN id % 3 <> 0 THEN old_user END AS fa, ' ' || user_id AS fb, old_category AS aa, category AS ab FROM p)
SELECT id, CASE WHEN len(ta) > 0 AND len(tb) > 0 AND ta <> tb OR len(ia) > 0 AND len(ib) > 0 AND ia <> ib THEN 'anchor-conflict' WHEN trim(fa) <> '' AND trim(fa) = trim(fb) THEN 'key:fact' WHEN trim(aa) <> '' AND trim(aa) = trim(ab) THEN 'key:atomic' WHEN len(ta) > 0 AND ta = tb OR len(ia) > 0 AND ia = ib THEN 'anchor-shared' ELSE 'unproven' END AS verdict FROM x""")
def referent_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for the fact key, a category for the atomic identity."""
    kinds = {"ticket": r"\b[A-Z]{2,6}-[0-9]+\b", "issue": r"#[0-9]+\b"}
    sides = [{k: F.regexp_extract_all(F.col(c), F.lit(p), F.lit(0)) for k, p in kinds.items()} for c in ("old", "text")]
    keys = {"fact": (F.when(F.col("id") % 3 != 0, F.col("old_user")), F.concat(F.lit(" "), "user_id")), "atomic": (F.col("old_category"), F.col("category"))}
    return tagged(spark, sf_dir).select("id", ch.proof(*sides, keys).alias("verdict"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, coalesce(nullif(trim(CASE id % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' ' || path ELSE NULL END), ''), nullif(trim(session_id), '')) AS value FROM mem")
def attribute_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("case id % 3 when 0 then ' ' when 1 then ' ' || path end")
    return memory_units(spark, sf_dir).select("id", ch.attribute(body, F.col("session_id")).alias("value"))


#: Every fourth record's vector is its predecessor's with a fifth of its own added: a near copy. Forty in a row are a user's.
PLANTED_SQL = f"""{MEMORY_SQL}, v AS (SELECT m.id, 'u' || (m.id // 40) AS user_id, m.active, m.created_at, coalesce(m.confidence, 0.0) AS confidence, coalesce(m.confidence, 0.5) AS standing, CASE WHEN m.id % 4 = 3 AND (b.embedding IS NULL OR m.embedding IS NULL) THEN NULL WHEN m.id % 4 = 3 THEN list_transform(list_zip(b.embedding, m.embedding), lambda z: z[1] + 0.2 * z[2]) ELSE m.embedding END AS e FROM mem m LEFT JOIN mem b ON b.id = m.id - 1)"""
FOLD_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o1, o2) AS k FROM near),
walk(g, k, lost, won) AS (SELECT DISTINCT g, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM r UNION ALL SELECT w.g, r.k, CASE WHEN list_contains(lost, a) OR list_contains(lost, b) THEN lost ELSE list_append(lost, loser) END, CASE WHEN list_contains(lost, a) OR list_contains(lost, b) THEN won ELSE list_append(won, CASE WHEN loser = a THEN b ELSE a END) END FROM walk w JOIN r ON r.g = w.g AND r.k = w.k + 1),
done AS (SELECT g, unnest(lost) AS id, unnest(won) AS winner FROM walk WHERE (g, k) IN (SELECT (g, max(k)) FROM walk GROUP BY g))"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.expr("'u' || cast(id div 40 as string)")
    rows = memory_units(spark, sf_dir).select("id", user.alias("user_id"), "active", "created_at", "confidence", "embedding")
    before = rows.select((F.col("id") + 1).alias("id"), F.col("embedding").alias("before"))
    near = F.zip_with("before", "embedding", lambda b, own: b + 0.2 * own)
    return rows.join(before, "id", "left").withColumn("embedding", F.when(F.col("id") % 4 == 3, near).otherwise(F.col("embedding"))).drop("before")


@R.query(f"""WITH RECURSIVE {PLANTED_SQL}, near AS (SELECT x.id // 16 AS g, x.id AS a, y.id AS b, x.id AS o1, y.id AS o2, CASE WHEN x.confidence >= y.confidence THEN y.id ELSE x.id END AS loser FROM v x JOIN v y ON x.id // 16 = y.id // 16 AND x.id < y.id WHERE list_cosine_similarity(x.e, y.e) > 0.85), {FOLD_SQL} SELECT g AS batch, id, winner FROM done""")
def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen records in a row are one batch."""
    return ch.batch_losers(planted(spark, sf_dir).withColumn("batch", F.expr("id div 16")), ["batch"])


@R.query(f"""WITH RECURSIVE {PLANTED_SQL}, old AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS scanned FROM v WHERE coalesce(active, true) AND e IS NOT NULL AND created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY standing DESC, id) AS place FROM old WHERE scanned <= 200),
near AS (SELECT x.user_id AS g, x.id AS a, y.id AS b, x.place AS o1, y.place AS o2, y.id AS loser FROM f x JOIN f y ON x.user_id = y.user_id AND x.place < y.place WHERE list_cosine_similarity(x.e, y.e) >= 0.88), {FOLD_SQL} SELECT g AS user_id, id, winner FROM done""")
def compaction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.compacted(planted(spark, sf_dir), F.to_timestamp(F.lit(NOW)))


POINTER = "CASE WHEN {i} % 31 = 5 THEN {i} + 12 WHEN {i} % 11 <> 0 AND {i} >= 4 THEN {i} - 4 END"


@R.query(f"""WITH RECURSIVE {MEMORY_SQL}, n AS (SELECT id, id % 4 AS user_id, {POINTER.format(i="id")} AS next FROM mem), walk(user_id, id, cur, k) AS (SELECT user_id, id, next, 1 FROM n WHERE next IS NOT NULL UNION ALL SELECT w.user_id, w.id, n.next, k + 1 FROM walk w JOIN n ON n.user_id = w.user_id AND n.id = w.cur WHERE n.next IS NOT NULL AND w.cur <> w.id AND k < 50)
SELECT user_id, id, min(CASE WHEN k = 1 THEN cur END) AS target, bool_or(cur = id) OR max(k) >= 50 AS cycle FROM walk GROUP BY user_id, id""")
def supersede_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most records point four back, in their own tenant; some point forward, so that walks turn in circles."""
    rows = memory_units(spark, sf_dir, ()).select((F.col("id") % 4).alias("user_id"), "id", F.expr(POINTER.format(i="id")).alias("next"))
    return ch.would_cycle(rows.withColumnRenamed("next", "target"), rows)


PACKET_SQL = r"""CASE WHEN regexp_matches(clean, '\b(secret|credential|api key|token|privacy|private|permission|approval|destructive|production|must|never|do not|don''t|avoid)\b', 'i') THEN 0
  WHEN regexp_matches(clean, '\b(vitest|typescript|eslint|npm|pnpm|yarn|gitnexus|beads|bd |claude|codex|opencode|surreal|sqlite|postgres|tool|cli|terminal|config|setting)\b', 'i') THEN 1
  WHEN regexp_matches(clean, '\b(style|format|lint|strict|naming|typescript|refactor|test|coverage|comment|ascii)\b', 'i') THEN 2
  WHEN regexp_matches(clean, '\b(plan|bead|handoff|review|verify|test harness|proof|phase|workflow|process|gate|commit|push)\b', 'i') THEN 3
  WHEN regexp_matches(clean, '\b(tone|concise|verbose|explain|wording|call me|address|speak|summary)\b', 'i') THEN 4
  WHEN regexp_matches(clean, '\b(ui|ux|frontend|design|color|palette|card|button|layout|dashboard|product)\b', 'i') THEN 5 ELSE 6 END"""
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\x1b\[[0-9;]*m', '', 'g'), '^>{1,2}[ \t\n\f\r]*', ''), '[ \t\n\f\r]+', ' ', 'g'))"


@R.query(rf"""WITH RECURSIVE {MEMORY_SQL}, h AS (SELECT user_id, session_id, id, text, category, coalesce(confidence, 0.0) AS score, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at DESC, id) AS place FROM mem),
i AS (SELECT *, {CLEAN_SQL} AS clean FROM h WHERE place <= 12 AND (category IN ('preferences', 'profile') OR regexp_matches(text, '\b(prefer|preference|preferred|likes?|dislikes?|usually|always|never|must|do not|don''t|avoid|style|convention|setting|configuration)\b', 'i'))),
r AS (SELECT user_id, session_id, id, ceil(length(clean) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id, session_id ORDER BY {PACKET_SQL}, score DESC, place) AS k FROM i WHERE clean <> ''),
walk(user_id, session_id, k, used, ids, left_out) AS (SELECT DISTINCT user_id, session_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT FROM r UNION ALL SELECT w.user_id, w.session_id, r.k, CASE WHEN used + tokens <= 600 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 600 THEN list_append(ids, r.id) ELSE ids END, CASE WHEN used + tokens <= 600 THEN left_out ELSE left_out + 1 END FROM walk w JOIN r ON r.user_id = w.user_id AND r.session_id = w.session_id AND r.k = w.k + 1)
SELECT user_id, session_id, used, array_to_string(ids, ',') AS ids, left_out FROM walk WHERE len(ids) > 0 AND (user_id, session_id, k) IN (SELECT (user_id, session_id, max(k)) FROM walk GROUP BY user_id, session_id)""")
def preference_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve newest records of a user's session are a query's hits."""
    newest = Window.partitionBy("user_id", "session_id").orderBy(F.desc("created_at"), "id")
    hits = memory_units(spark, sf_dir, ("labels",)).withColumn("place", F.row_number().over(newest)).where("place <= 12").withColumn("score", F.coalesce("confidence", F.lit(0.0)))
    return ch.preference_packet(hits, ["user_id", "session_id"]).withColumn("ids", F.array_join("ids", ","))


def hash_sql(*parts: str) -> str:
    return "sha256(" + " || chr(0) || ".join(f"coalesce({p}, '')" for p in parts) + ")"


@R.query(rf"""WITH {MEMORY_SQL}, n AS (SELECT *, CASE WHEN id % 3 = 0 THEN upper(category) || '  x' WHEN id % 3 = 1 THEN ' ' END AS subject FROM mem), p AS (SELECT *, coalesce(nullif({decisions.norm_sql("subject")}, ''), nullif({decisions.norm_sql("category")}, ''), 'memory') AS s, coalesce(nullif({decisions.norm_sql("memory_role")}, ''), 'states') AS q FROM n),
k AS (SELECT *, left({hash_sql("'claim-v1'", "user_id", "coalesce(scope, 'user')", "coalesce(path, '*')", "CASE WHEN id % 2 = 0 THEN 'f' || id END", "s", "q")}, 32) AS claim_key FROM p)
SELECT id, claim_key, {hash_sql("'revision-v1'", "claim_key", r"trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))")} AS revision, left(sha256('record-v1::' || claim_key), 24) AS record_id FROM k""")
def claim_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some claims name a subject, a blank or none; every other one has a fact key."""
    subject = F.expr("case id % 3 when 0 then upper(category) || '  x' when 1 then ' ' end")
    fact = F.expr("case when id % 2 = 0 then ' f' || id end")
    named = ch.identity_part(subject, F.col("category"), F.lit("memory")), ch.identity_part(F.col("memory_role"), F.lit("states"))
    contract = ch.claim_contract(F.col("user_id"), F.col("scope"), F.col("path"), fact, *named, F.col("text"))
    return memory_units(spark, sf_dir, ()).select("id", *[c.alias(name) for name, c in contract.items()])


STATUS = "CASE {i} % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'rejected' WHEN 4 THEN 'odd' END"


@R.query(f"""WITH {MEMORY_SQL}, r AS (SELECT id, {STATUS.format(i="id")} AS a, {STATUS.format(i="(id // 6)")} AS b FROM mem), s AS (SELECT id, CASE WHEN a IN ('active', 'superseded', 'conflicted', 'rejected') THEN a ELSE 'active' END AS old, CASE WHEN b IN ('active', 'superseded', 'conflicted', 'rejected') THEN b ELSE 'active' END AS new FROM r)
SELECT id, old, new, old = new OR old = 'active' OR old = 'conflicted' AS allowed FROM s""")
def claim_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = ch.claim_status(F.expr(STATUS.format(i="id"))), ch.claim_status(F.expr(STATUS.format(i="(id div 6)")))
    return memory_units(spark, sf_dir, ()).select("id", old.alias("old"), new.alias("new"), ch.allowed_transition(old, new).alias("allowed"))
