"""Consolidation, orphans and accrual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import upkeep as up
from palimpsest.plans.lifecycle import TOK
from palimpsest.plans.recall import COSINE
from palimpsest.plans.recall_many import VALUES_SQL
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table

R = Registry()


def value_tokens_sql(text: str) -> str:
    return "list_distinct(list_transform(" + " || ".join(f"regexp_extract_all({text}, '{p}', 0)" for p in VALUES_SQL) + ", lambda x: lower(x)))"


SWEPT_SQL = f"""base AS (SELECT id, user_id, scope, text, embedding, created_at FROM mem WHERE embedding IS NOT NULL),
r AS (SELECT *, {value_tokens_sql('text')} AS vals FROM (SELECT * FROM base UNION ALL
  SELECT id + 1000000, user_id, scope, CASE WHEN id % 8 = 0 THEN text || ' v2.0' ELSE regexp_replace(text, '[0-9]', '', 'g') END, list_concat([embedding[1] + 0.3], embedding[2:]), created_at + INTERVAL 1 HOUR FROM base WHERE id % 4 = 0))"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that have a vector, and of one in four a near copy of an hour later: with another value, or without
    any number."""
    columns = ("id", "user_id", "scope", "text", "embedding", "created_at")
    base = memory_units(spark, sf_dir, ("embeddings",)).where("embedding is not null").select(*columns)
    text = F.when(F.col("id") % 8 == 0, F.concat("text", F.lit(" v2.0"))).otherwise(F.regexp_replace("text", "[0-9]", ""))
    turned = F.transform("embedding", lambda x, i: x + F.when(i == 0, 0.3).otherwise(0.0))
    copies = base.where("id % 4 = 0").select((F.col("id") + 1000000).alias("id"), "user_id", "scope", text.alias("text"), turned.alias("embedding"), (F.col("created_at") + F.expr("interval 1 hour")).alias("created_at"))
    return base.unionByName(copies).withColumn("written_at", F.col("created_at"))


@R.query(f"""WITH {MEMORY_SQL}, {SWEPT_SQL}, p AS (SELECT o.id, n.id AS superseded_by, round({COSINE.format(a='o.embedding', b='n.embedding')}, 6) AS similarity, row_number() OVER (PARTITION BY o.id ORDER BY n.created_at, n.id) AS k
  FROM r o JOIN r n ON o.user_id = n.user_id AND o.scope = n.scope AND (n.created_at, n.id) > (o.created_at, o.id)
  WHERE {COSINE.format(a='o.embedding', b='n.embedding')} >= 0.9 AND len(list_filter(o.vals, lambda v: NOT list_contains(n.vals, v))) = 0)
SELECT id, superseded_by, similarity FROM p WHERE k = 1""")
def consolidation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in one sweep; tests hold several sweeps against it."""
    return up.sweep(planted(spark, sf_dir))[0].withColumn("similarity", F.round("similarity", 6))


@R.query(f"""WITH {MEMORY_SQL}, {SWEPT_SQL}, e AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS entity FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000, l_suppkey FROM lineitem WHERE l_quantity > 20),
n AS (SELECT x.id AS a, y.id AS b, round({COSINE.format(a='x.embedding', b='y.embedding')}, 6) AS similarity FROM r x JOIN r y ON x.user_id = y.user_id AND x.id < y.id WHERE {COSINE.format(a='x.embedding', b='y.embedding')} >= 0.82)
SELECT a, b, similarity, count(*) AS shared FROM n JOIN e p ON p.id = a JOIN e q ON q.id = b AND p.entity = q.entity GROUP BY a, b, similarity""")
def orphan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted rows as orphans; parts as their records, suppliers as entities."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("id"))
    copies = line.where("l_quantity > 20").select(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") + 1000000).alias("id"))
    return up.near_orphans(planted(spark, sf_dir), edges.unionByName(copies)).withColumn("similarity", F.round("similarity", 6))


@R.query(f"""WITH {MEMORY_SQL}, tr AS (SELECT user_id, user_id % 7 AS session_id, ts AS at, max(event_id) AS trace_id FROM events WHERE event_type IN ('view', 'signup') GROUP BY ALL),
cap AS (SELECT e.user_id, e.user_id % 7 AS session_id, ts AS at, event_id, substr(text, 1, 300) AS answer FROM events e JOIN documents d ON d.doc_id = event_id % 200 WHERE event_type = 'click'),
told AS (SELECT cap.answer, trace_id FROM cap ASOF JOIN tr ON cap.user_id = tr.user_id AND cap.session_id = tr.session_id AND cap.at >= tr.at WHERE trim(cap.answer) <> ''),
items AS (SELECT answer, trace_id % 3 = 0 AS status, unnest([trace_id % 200, (trace_id + 1) % 200, (trace_id * 7) % 230]) AS id, trace_id, row_number() OVER () AS told FROM told),
f AS (SELECT i.id, m.confidence AS prior, status, least(greatest(0.65 * CASE WHEN len({TOK('m.t')}) = 0 THEN 0.0 ELSE len(list_intersect({TOK('m.t')}, {TOK('answer')})) / len({TOK('m.t')}) END + 0.35 * 0.7, 0.0), 1.0) AS ev
  FROM (SELECT DISTINCT * FROM items) i JOIN (SELECT id, confidence, substr(text, 1, 300) AS t FROM mem) m ON m.id = i.id),
u AS (SELECT id, least(greatest(coalesce(max(prior), 0.5), 0.0), 1.0) AS p, sum(ev) AS s, sum(1 - ev) AS t, count(*) AS retrieved, count(*) FILTER (WHERE ev >= 0.35) AS used, count(*) FILTER (WHERE ev >= 0.7) AS successful,
  count(*) FILTER (WHERE status) AS status_retrieved, count(*) FILTER (WHERE status AND ev >= 0.35) AS status_used FROM f GROUP BY id)
SELECT id, retrieved, used, successful, status_retrieved, status_used, round((1 + 4 * p + s) / (6 + s + t), 6) AS usefulness FROM u""")
def usefulness_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and signups as traces, clicks as captures that end in an answer."""
    events = table(spark, sf_dir, "events").withColumns({"session_id": F.col("user_id") % 7, "at": F.col("ts")})
    n = F.col("event_id")
    traces = events.where("event_type in ('view', 'signup')").select("user_id", "session_id", "at", n.alias("trace_id"), F.array(n % 200, (n + 1) % 200, n * 7 % 230).alias("items"), (n % 3 == 0).alias("status"))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("said"), F.substring("text", 1, 300).alias("answer"))
    captures = events.where("event_type = 'click'").withColumn("said", n % 200).join(said, "said").select("user_id", "session_id", "at", "event_id", "answer")
    records = memory_units(spark, sf_dir, ("labels",)).select("id", F.substring("text", 1, 300).alias("text"), F.col("confidence").alias("prior"))
    found = up.accrued(captures, traces, records, ["user_id", "session_id"])
    return found.select("id", "retrieved", "used", "successful", "status_retrieved", "status_used", F.round("usefulness", 6).alias("usefulness"))
