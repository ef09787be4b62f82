"""Recall for many queries in one pass: one record in a hundred asks all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import collapse as cl
from palimpsest.operators import exact_qa
from palimpsest.operators import recall_many as rm
from palimpsest.plans.recall import COSINE, now_col
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, NOW, memory_units

R = Registry()
LIMIT = 15


def asked(memories: DataFrame) -> DataFrame:
    """Every record whose id 100 divides asks with its first hundred characters; of every two one asks exactly."""
    text = F.concat(F.when(F.col("id") % 200 == 0, "which value is ").otherwise(""), F.substring("text", 1, 100))
    mode = F.when(F.col("id") % 300 == 0, "primary").when(F.col("id") % 300 == 100, "annotation").otherwise("disabled")
    return memories.where("id % 100 = 0").select(F.col("id").alias("query_id"), text.alias("text"), "embedding", mode.alias("mode"))


def memories_and_texts(spark: SparkSession, sf_dir: str, joined: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The memories, the queries of asked(), written, and the memories' texts without a join."""
    memories = memory_units(spark, sf_dir, joined)
    return memories, rm.written(asked(memories)), memory_units(spark, sf_dir, ())


def claims_of(memories: DataFrame) -> DataFrame:
    """Pinned records as claims, which their own and the next two records support."""
    return memories.where("pinned").select(
        (F.col("id") + 1000000000).alias("id"), "text", "embedding", F.when(F.col("id") % 350 == 0, "draft").otherwise("active").alias("status"),
        F.lit(True).alias("active"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("claim_key"), F.array("id", F.col("id") + 1, F.col("id") + 2).alias("supports"),
    )


# --- the same in SQL

TOKENS_SQL = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
STOP_SQL = """['a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'do', 'for', 'from', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'let', 'me', 'my',
  'of', 'on', 'or', 'our', 'should', 'that', 'the', 'their', 'them', 'there', 'these', 'they', 'this', 'those', 'to', 'up', 'us', 'was', 'we', 'what', 'when',
  'where', 'which', 'who', 'why', 'will', 'with', 'you', 'your']"""
EXACT_STOP_SQL = """['a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'do', 'does', 'for', 'from', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'me', 'my',
  'of', 'on', 'or', 'our', 'should', 'that', 'the', 'their', 'them', 'there', 'these', 'they', 'this', 'those', 'to', 'up', 'us', 'was', 'we', 'what', 'when',
  'where', 'which', 'who', 'why', 'will', 'with', 'you', 'your']"""
VALUES_SQL = (
    r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d+(?:\.\d+){1,}\b", r"\b\d+\b", r"\b[A-Z][A-Za-z0-9_-]*-\d+\b", r"\b[A-Z][A-Z0-9_]{2,}\b", "`[^`]+`", r"/[\w./-]+",
    r"(?i)\b[\w.-]+\.(?:ts|tsx|js|jsx|json|md|py|rs|go|sql|yaml|yml)\b", r"(?i)\b[a-f0-9]{7,40}\b", r"\b[A-Z0-9_]+=[^\s]+", r"(?i)https?://\S+",
)
LIST_SQL = r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S"


def value_sql(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in (*VALUES_SQL, LIST_SQL)) + ")"


def kept_sql(found: str, stop: str) -> str:
    some = f"list_filter(list_distinct({found}), lambda x: len(x) > 2 AND NOT list_contains({stop}, x))"
    return f"CASE WHEN len({some}) > 0 THEN {some} ELSE list_distinct({found}) END"


def normal_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[`\"'']', '', 'g'), '\\s+', ' ', 'g'))"


def exact_tokens_sql(normal: str) -> str:
    return kept_sql(f"regexp_extract_all({normal}, '[\\p{{L}}\\p{{N}}_./:-]+')", EXACT_STOP_SQL)


INTENT_SQL = r"regexp_matches({q}, '(?i)\b(?:exact(?:ly)?|verbatim|which|when|what|who|how many|list|version|port|commit|date|value|answer)\b')"
ASKED_SQL = f"""q AS (SELECT id AS query_id, CASE WHEN id % 200 = 0 THEN 'which value is ' ELSE '' END || substr(text, 1, 100) AS q_text, embedding AS q_vector,
  CASE WHEN id % 300 = 0 THEN 'primary' WHEN id % 300 = 100 THEN 'annotation' ELSE 'disabled' END AS mode FROM mem WHERE id % 100 = 0),
qt AS (SELECT query_id, unnest({kept_sql(TOKENS_SQL.format(text='q_text'), STOP_SQL)}) AS term FROM q)"""
CLAIMS_SQL = """claims AS (SELECT id + 1000000000 AS id, text, embedding, CASE WHEN id % 350 = 0 THEN 'draft' ELSE 'active' END AS status, 'c' || (id % 3) AS claim_key,
  [id, id + 1, id + 2] AS supports FROM mem WHERE pinned), live AS (SELECT *, lower(text) AS text_norm FROM claims WHERE status = 'active')"""


def best_sql(name: str, scored: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({scored})) WHERE rank <= {k})"


def vector_sql(table: str) -> str:
    return f"SELECT query_id, id, round({COSINE.format(a='embedding', b='q_vector')}, 9) AS score FROM q, {table} WHERE embedding IS NOT NULL AND q_vector IS NOT NULL"


def keyword_sql(name: str, table: str, k: int) -> str:
    return f"""
{name}_stats AS (SELECT count(*) AS n, avg(len(string_split(text_norm, ' '))) AS avgdl FROM {table}),
{name}_bag AS (SELECT id, {TOKENS_SQL.format(text='text')} AS t FROM {table}),
{name}_hits AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM {name}_bag),
{name}_tf AS (SELECT id, dl, term, count(*) AS tf FROM {name}_hits WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_w AS (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM {name}_tf JOIN {name}_df USING (term), {name}_stats),
{best_sql(name, f'SELECT query_id, id, round(sum(w), 9) AS score FROM {name}_w JOIN qt USING (term) GROUP BY query_id, id', k)}"""


RECENT_SQL = f"SELECT query_id, id, epoch(created_at)::DOUBLE AS score FROM mem, q WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND created_at <= TIMESTAMP '{NOW}'"


def fused_sql(name: str, legs: dict[str, tuple[str, float]], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, rank, '{leg}' AS leg, {w}::DOUBLE / (60 + rank) AS part FROM {table}" for leg, (table, w) in legs.items())
    ranks = ", ".join(f"max(rank) FILTER (WHERE leg = '{leg}') AS {leg}_rank" for leg in legs)
    return best_sql(name, f"SELECT query_id, id, round(sum(part), 9) AS score, {ranks} FROM ({parts}) GROUP BY query_id, id", k)


def hybrid_sql(name: str, limit: int) -> str:
    legs = {"vector": ("v", 1.0), "bm25": ("b", 1.2), "recency": ("r", 0.8)}
    return f"{best_sql('v', vector_sql('mem'), 3 * limit)}, {keyword_sql('b', 'mem', 3 * limit)}, {best_sql('r', RECENT_SQL, 3 * limit)}, {fused_sql(name, legs, limit)}"


def claim_leg_sql(limit: int) -> str:
    limit = min(limit, 50)
    depth = min(4 * limit, 200)
    return f"{CLAIMS_SQL}, {best_sql('cv', vector_sql('live'), depth)}, {keyword_sql('cb', 'live', depth)}, {fused_sql('found', {'vector': ('cv', 1.0), 'bm25': ('cb', 1.2)}, limit)}"


@R.query(f"WITH {MEMORY_SQL}, {ASKED_SQL}, {hybrid_sql('best', LIMIT)} SELECT query_id, id, rank, round(score, 6) AS score, vector_rank, bm25_rank, recency_rank FROM best")
def many_hybrid_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, queries, texts = memories_and_texts(spark, sf_dir, ("embeddings",))
    return rm.hybrid(memories, queries, now_col(), LIMIT, texts=texts).withColumn("score", F.round("score", 6))


@R.query(f"WITH {MEMORY_SQL}, {ASKED_SQL}, {claim_leg_sql(LIMIT)} SELECT query_id, id, rank, round(score, 6) AS score, vector_rank, bm25_rank FROM found")
def claim_mini_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, queries, _ = memories_and_texts(spark, sf_dir, ("embeddings",))
    return rm.claim_candidates(rm.written(claims_of(memories)), queries, LIMIT).withColumn("score", F.round("score", 6))


EXACT_SQL = f"""CASE WHEN trim(q_text) <> '' AND trim(text) <> '' AND {INTENT_SQL.format(q='trim(q_text)')} THEN
  least(1.0, len(list_filter(q_tokens, lambda x: contains(body, x))) / len(q_tokens) + CASE WHEN {value_sql('body')} THEN 0.25 ELSE 0.0 END) ELSE 0.0 END"""
FLOW_SQL = f"""{hybrid_sql('fused', 3 * LIMIT)}, {claim_leg_sql(3 * LIMIT)},
qn AS (SELECT *, {exact_tokens_sql(normal_sql('q_text'))} AS q_tokens FROM q),
lift_in AS (SELECT query_id, f.id, f.score, text, {normal_sql('text')} AS body, q_text, q_tokens FROM fused f JOIN mem ON mem.id = f.id JOIN qn USING (query_id)),
lift_ex AS (SELECT query_id, id, score, {EXACT_SQL} AS exact FROM lift_in),
lifted AS (SELECT query_id, id, round(score + CASE WHEN exact >= 0.5 THEN 0.05 * exact ELSE 0.0 END, 9) AS score FROM lift_ex),
leg AS (SELECT query_id, f.id, f.score, supports, mode FROM found f JOIN claims c ON c.id = f.id JOIN q USING (query_id)),
blocked AS (SELECT query_id, unnest(supports) AS id FROM leg WHERE mode = 'primary'),
merged AS (
  SELECT query_id, id, score, 'memory' AS kind FROM lifted WHERE (query_id, id) NOT IN (SELECT query_id, id FROM blocked)
  UNION ALL SELECT query_id, id, score, 'claim' FROM leg WHERE mode = 'primary'
  UNION ALL SELECT query_id, id, round(score * 0.6, 9), 'claim' FROM leg WHERE mode = 'annotation' AND query_id NOT IN (SELECT query_id FROM lifted)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS place FROM merged) WHERE place <= {3 * LIMIT}),
texts AS (SELECT 'memory' AS kind, id, text, embedding FROM mem UNION ALL SELECT 'claim', id, text, embedding FROM claims),
judge_in AS (SELECT query_id, kind, p.id, p.score AS fused, text, {normal_sql('text')} AS body, q_text, q_tokens,
  CASE WHEN embedding IS NOT NULL AND q_vector IS NOT NULL THEN round({COSINE.format(a='embedding', b='q_vector')}, 9) END AS cosine
  FROM pool p JOIN texts t USING (kind, id) JOIN qn USING (query_id)),
judged AS (SELECT query_id, kind, id, fused, cosine, round({EXACT_SQL}, 9) AS exact,
  CASE WHEN cosine >= 0.7 THEN 'direct' WHEN cosine >= 0.5 THEN 'supporting' WHEN cosine >= 0.3 THEN 'background' END AS label FROM judge_in),
seen AS (SELECT *, count(label) OVER (PARTITION BY query_id) > 0 AS any_label FROM judged),
kept AS (SELECT *, any_label AND label IS NULL AND exact >= 0.55 AS preserved, CASE WHEN any_label AND label IS NOT NULL THEN cosine ELSE fused END AS score
  FROM seen WHERE NOT any_label OR label IS NOT NULL OR exact >= 0.55)"""


@R.query(f"""WITH {MEMORY_SQL}, {ASKED_SQL}, {FLOW_SQL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id)::INTEGER AS rank, kind, id, round(score, 6) AS score, round(fused, 6) AS fused,
  round(cosine, 6) AS cosine, round(exact, 6) AS exact, label, preserved FROM kept""")
def many_recalls_with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, queries, texts = memories_and_texts(spark, sf_dir, ("embeddings",))
    found = rm.recall(memories, rm.written(claims_of(memories)), queries, now_col(), LIMIT, read_texts=texts)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "fused", "cosine", "exact")})


# --- contradiction collapse over the many recalls

FIRST_SQL = r"""CASE WHEN regexp_matches(trim(text, E' \t\n\r\x0b\f') || ' ', '(?s)^.*?(?:[。！？]|[.!?]\s)')
  THEN rtrim(regexp_extract(trim(text, E' \t\n\r\x0b\f') || ' ', '(?s)^.*?(?:[。！？]|[.!?]\s)'), E' \t\n\r\x0b\f') ELSE trim(text, E' \t\n\r\x0b\f') END"""
KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(first), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
PREDICATES_SQL = (" switched to ", " changed to ", " updated to ", " replaced ", " uses ", " use ", " is ", " are ", " was ", " were ", " = ", ":")


def claim_part_sql(part: str) -> str:
    def one(p: str) -> str:
        at = f"strpos(norm, '{p}')"
        subject, value = f"trim(substr(norm, 1, {at} - 1))", f"trim(substr(norm, {at} + {len(p)}))"
        return f"WHEN {at} > 4 AND {subject} <> '' AND {value} <> '' THEN " + {"subject": subject, "predicate": f"'{p.strip()}'", "value": value}[part]

    return "CASE " + " ".join(map(one, PREDICATES_SQL)) + " END"


def compact_sql(text: str) -> str:
    sentences = rf"len(list_filter(regexp_split_to_array(regexp_replace({text}, '([.!?])\s+', E'\\1\n', 'g'), '\n+'), lambda s: regexp_matches(s, '\S')))"
    return f"({sentences} <= 2 AND len({exact_tokens_sql(normal_sql(text))}) <= 30)"


SHARED_SQL = "len(list_intersect(x.s_tokens, y.s_tokens)) / least(len(x.s_tokens), len(y.s_tokens))"
DISTINCT_SQL = f"""CASE WHEN len(x.items) > 1 AND len(y.items) > 1 THEN x.items_norm <> y.items_norm
  WHEN x.subject IS NULL OR y.subject IS NULL OR NOT x.first_compact OR NOT y.first_compact THEN false
  ELSE NOT (x.subject = y.subject OR (len(x.s_tokens) > 0 AND len(y.s_tokens) > 0 AND {SHARED_SQL} >= 0.6)) AND x.predicate = y.predicate
    AND x.value <> '' AND y.value <> '' AND x.value <> y.value AND NOT contains(x.value, y.value) AND NOT contains(y.value, x.value) AND (x.value_signal OR y.value_signal) END"""
ITEMS_SQL = rf"""CASE WHEN regexp_matches(first, '{LIST_SQL}') THEN list_filter(list_transform(regexp_split_to_array(first, '\n+'),
  lambda s: regexp_replace(regexp_replace(s, '^\s*(?:[-*+]|\d+[.)])\s+', ''), '^\s+|\s+$', '', 'g')), lambda s: s <> '') ELSE [] END"""
COLLAPSE_SQL = f"""{hybrid_sql('best', LIMIT)},
hit AS (SELECT best.query_id, best.id, rank - 1 AS place, best.score, mem.text AS whole, substr(mem.text, 1, 60 + (best.id % 2)::INTEGER * 40) AS text, path, confidence, created_at FROM best JOIN mem ON mem.id = best.id),
h1 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY path IS NULL, coalesce(confidence, 0.0) DESC, created_at DESC NULLS LAST, score DESC) AS strength, {FIRST_SQL} AS first FROM hit),
h2 AS (SELECT *, {KEY_SQL} AS key, {normal_sql('first')} AS norm, {compact_sql('text')} AS compact, {compact_sql('first')} AS first_compact, {ITEMS_SQL} AS items FROM h1),
h3 AS (SELECT *, list_distinct(list_filter(string_split(key, ' '), lambda w: w <> '')) AS words, {claim_part_sql('subject')} AS subject, {claim_part_sql('predicate')} AS predicate, {claim_part_sql('value')} AS value,
  {normal_sql("array_to_string(items, E'\\n')")} AS items_norm FROM h2),
h4 AS (SELECT *, {exact_tokens_sql(normal_sql('subject'))} AS s_tokens, {value_sql('value')} AS value_signal FROM h3),
met AS (SELECT x.query_id, x.place AS x, y.place AS y, y.strength < x.strength AS y_wins FROM h4 x JOIN h4 y ON x.query_id = y.query_id AND x.place < y.place
  WHERE (x.key = y.key OR CASE WHEN len(x.words) = 0 AND len(y.words) = 0 THEN 1.0 ELSE len(list_intersect(x.words, y.words)) / len(list_distinct(x.words || y.words)) END > 0.7)
    AND NOT {DISTINCT_SQL} AND x.compact AND y.compact),
codes AS (SELECT query_id, list(a * 1000 + b) AS meets, coalesce(list(a * 1000 + b) FILTER (WHERE b_wins), []) AS beats FROM (
  SELECT query_id, x AS a, y AS b, y_wins AS b_wins FROM met UNION ALL SELECT query_id, y, x, NOT y_wins FROM met) GROUP BY query_id),
walk AS (
  SELECT query_id, -1::BIGINT AS pos, []::BIGINT[] AS stay, max(place)::BIGINT AS last, any_value(meets) AS meets, any_value(beats) AS beats FROM hit LEFT JOIN codes USING (query_id) GROUP BY query_id
  UNION ALL
  SELECT query_id, pos + 1, CASE WHEN one IS NULL THEN list_append(stay, pos + 1) WHEN list_contains(beats, one * 1000 + pos + 1) THEN list_transform(stay, lambda s: CASE WHEN s = one THEN pos + 1 ELSE s END) ELSE stay END, last, meets, beats
  FROM (SELECT *, list_filter(stay, lambda s: coalesce(list_contains(meets, s * 1000 + pos + 1), false))[1] AS one FROM walk WHERE pos < last)),
stays AS (SELECT query_id, unnest(stay) AS place FROM walk WHERE pos = last)"""


@R.query(f"WITH RECURSIVE {MEMORY_SQL}, {ASKED_SQL}, {COLLAPSE_SQL} SELECT query_id, id, place + 1 AS rank, strength FROM h1 SEMI JOIN stays USING (query_id, place)")
def contradiction_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 or 100 characters of the recalled records are the hits: near copies among them collide."""
    memories, queries, texts = memories_and_texts(spark, sf_dir, ("embeddings",))
    best = rm.hybrid(memories, queries, now_col(), LIMIT, texts=texts).select("query_id", "id", "rank", "score")
    shown = memory_units(spark, sf_dir, ("labels",)).select("id", F.expr("substring(text, 1, 60 + cast(id % 2 as int) * 40)").alias("text"), "path", "confidence", F.col("created_at").alias("dated"))
    hits = rm.written(best.join(shown, "id"))
    stay = cl.collapse(hits)
    return cl.ordered(hits).join(stay.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "rank", "strength")


@R.query(f"""WITH {MEMORY_SQL}, h1 AS (SELECT id, substr(text, 1, 80) AS first FROM mem), h2 AS (SELECT *, {normal_sql('first')} AS norm FROM h1)
SELECT id, {claim_part_sql('subject')} AS subject, {claim_part_sql('predicate')} AS predicate, {claim_part_sql('value')} AS value, {compact_sql('first')} AS compact FROM h2""")
def comparable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, predicate and value of each record's first 80 characters, and whether they can be compared as one claim."""
    text: Column = F.substring("text", 1, 80)
    parted = memory_units(spark, sf_dir).select("id", exact_qa.claim(text).alias("c"), exact_qa.is_compact(text).alias("compact"))
    return parted.select("id", "c.subject", "c.predicate", "c.value", "compact")
