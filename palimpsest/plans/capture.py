"""Capture support: message scores, decisions, dates, keys, watermarks and streams in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import capture as cp
from palimpsest.operators import lifecycle as lc
from palimpsest.plans.arbitration import NORM
from palimpsest.plans.registry import Registry
from palimpsest.plans.scans import rx
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table
from palimpsest.streaming import turns as stream

R = Registry()
T = "trim(text)"
CJK = "[一-鿿぀-ヿ가-힯]"


@R.query(f"""SELECT conv_id, turn, role, CASE WHEN {T} = '' THEN 0.0 WHEN {rx(T, cp.TOOL)} THEN 1.0 WHEN {rx(T, cp.CORRECTION)} THEN 0.95 WHEN {rx(T, cp.DECISION)} THEN 0.85 WHEN {rx(T, cp.SYSTEM_XML[:1])} AND {rx(T, cp.SYSTEM_XML[1:])} THEN 0.3
  WHEN {rx(T, cp.EXACT)} THEN 0.82 WHEN {rx(T, cp.ACKNOWLEDGE)} THEN 0.1 WHEN length({T}) > CASE WHEN regexp_matches({T}, '{CJK}') THEN 30 ELSE 80 END THEN 0.7 WHEN contains({T}, '?') OR contains({T}, '？') THEN 0.5 ELSE 0.4 END::DOUBLE AS score FROM conversations""")
def message_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", cp.message_score(F.col("text")).alias("score"))


LEFT = "list_min(list_filter([" + ", ".join(f"strpos(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in cp.DECISION_MARKERS) + "], lambda x: x > 0))"


@R.query(f"SELECT conv_id, turn, role, {LEFT} AS at FROM conversations WHERE {LEFT} IS NOT NULL")
def decision_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", cp.leftmost(F.col("text"), cp.DECISION_MARKERS).alias("at")).where("at is not null")


def days(event: str) -> str:
    return f"CASE WHEN {event} % 4 = 0 THEN 'done yesterday' WHEN {event} % 4 = 1 THEN 'fixed ' || ({event} % 9) || ' days ago' WHEN {event} % 4 = 2 THEN 'planned next month' ELSE 'nothing' END"


@R.query(f"""WITH t AS (SELECT event_id, ts::DATE AS d, {days('event_id')} AS text FROM events),
r AS (SELECT event_id, text, CASE WHEN regexp_matches(text, '\\b[0-9]{{1,4}} days ago\\b') THEN strftime(d - regexp_extract(text, '([0-9]+) days ago', 1)::INTEGER, '%Y-%m-%d') WHEN contains(text, 'yesterday') THEN strftime(d - 1, '%Y-%m-%d')
  WHEN contains(text, 'next month') THEN strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y-%m') END AS v FROM (SELECT event_id, d, text FROM t))
SELECT event_id, CASE WHEN v IS NULL THEN text ELSE text || ' (' || v || ')' END AS text FROM r""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "done yesterday").when(e % 4 == 1, F.concat(F.lit("fixed "), (e % 9).cast("string"), F.lit(" days ago"))).when(e % 4 == 2, "planned next month").otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("d"), text.alias("text")).select("event_id", cp.with_dates(F.col("text"), F.col("d")).alias("text"))


@R.query("SELECT conv_id, turn, role, text FROM conversations WHERE turn >= conv_id % 3")
def turn_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    marks = turns.select("conv_id").distinct().withColumn("captured", F.col("conv_id") % 3)
    return stream.after_watermark(turns, marks, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@R.query("WITH t AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), s AS (SELECT event_type, ts, sum(n) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t) SELECT event_type, min(ts) AS since, count(*) AS hits FROM s GROUP BY event_type, k")
def access_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.debounced_access(table(spark, sf_dir, "events"), ["event_type"], "60 seconds")


@R.query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS since, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed_counts(table(spark, sf_dir, "events"), ["event_type"]).withColumn("total", F.round("total", 4))


@R.query(f"WITH {MEMORY_SQL} SELECT id, sha256(concat_ws(':', coalesce(path, '?'), user_id))[1:24] AS project_key, sha256(category || chr(0) || {NORM('text')}) AS claim_hash FROM mem")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.substring(F.sha2(F.concat_ws(":", F.coalesce("path", F.lit("?")), "user_id"), 256), 1, 24)
    claim = F.sha2(F.concat(F.col("category"), F.lit("\x00"), tx.normalised(F.col("text"))), 256)
    return memory_units(spark, sf_dir, ()).select("id", project.alias("project_key"), claim.alias("claim_hash"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, list_filter(list_transform(string_split(text_norm, ' ')[1:14], lambda x: trim(x)), lambda x: x <> '')[1:10] AS tags FROM mem")
def tag_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", cp.tags(F.slice(F.split("text_norm", " "), 1, 14)).alias("tags"))


@R.query("SELECT page_id, regexp_extract_all(html, '<li>([^<]*)</li>', 1) AS items, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n_text FROM pages")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract_all("html", F.lit("<li>([^<]*)</li>"), F.lit(1)).alias("items"), F.length(F.regexp_replace("html", "<[^>]*>", " ")).cast("long").alias("n_text"))


@R.query("WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, turn, role, length(coalesce(before, '')) + length(text) + length(coalesce(after, '')) AS span FROM t")
def source_turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    span = length(F.lag("text").over(w)) + F.length("text") + length(F.lead("text").over(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", span.cast("long").alias("span"))


@R.query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 12")
def think_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.retrieval import top_per

    kept = top_per(table(spark, sf_dir, "orders"), ["o_custkey"], 12, F.desc("o_totalprice"), F.asc("o_orderkey"))
    return kept.select("o_custkey", "o_orderkey", F.col("rank").alias("place"))


@R.query("SELECT event_id, event_type, user_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def trace_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.coalesce(k, F.lit(-1)).alias("k"))


@R.query("WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM s WHERE k = 1")
def latest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return lc.newest_per_key(rows, ["user_id"], F.desc("ts"), F.desc("event_id")).where("keeps").select("user_id", "event_id", "event_type")


@R.query(f"WITH {MEMORY_SQL} SELECT id, path IS NOT NULL AS has_path, embedding IS NULL AS unembedded, confidence IS NULL AS unenriched FROM mem")
def backfill_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = lambda c: F.col(c).isNull()
    return memory_units(spark, sf_dir).select("id", (~null("path")).alias("has_path"), null("embedding").alias("unembedded"), null("confidence").alias("unenriched"))


def evidence_key(c: str) -> Column:
    return F.concat_ws(":", F.col(c), F.lit("event"))


@R.query("SELECT event_type || ':event' AS source_key, user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY ALL")
def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("source_key", evidence_key("event_type"))
    return rows.groupBy("source_key", "user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@R.query()
def compressed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgeted compression: greedy in score order, so per conversation in pandas; tested on small rows."""
    return cp.compress(table(spark, sf_dir, "conversations"), "conv_id", 400)


@R.query()
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text, so that near copies with another tail differ. No twin; tested against brute force."""
    return memory_units(spark, sf_dir, ()).select("id", cp.fact_key(F.col("category"), F.col("text")).alias("fact_key"))
