"""Write arbitration and text signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import arbitration as ar
from palimpsest.operators.stored import written
from palimpsest.plans.registry import Registry
from palimpsest.plans.scans import COS
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table

R = Registry()
NORM = lambda c: f"trim(regexp_replace(lower({c}), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def place(norm: str, least: int) -> str:
    """1-based place of the leftmost delimiter from `least` (0-based) on."""
    return "least(" + ", ".join(f"nullif(strpos(substr({norm}, {least + 1}), '{d}'), 0)" for d in tx.DELIMITERS) + f") + {least}"


def key_sql(norm: str) -> str:
    at = place(norm, 8)
    return f"CASE WHEN {at} IS NOT NULL THEN trim(substr({norm}, 1, {at} - 1)) ELSE array_to_string(string_split({norm}, ' ')[1:8], ' ') END"


def value_sql(norm: str) -> str:
    at = place(norm, 0)
    ladder = " ".join(f"WHEN starts_with(substr({norm}, {at}), '{d}') THEN trim(substr({norm}, {at} + {len(d)}))" for d in tx.DELIMITERS)
    return f"CASE WHEN {at} IS NOT NULL THEN CASE {ladder} END ELSE {norm} END"


@R.query(f"WITH {MEMORY_SQL}, n AS (SELECT id, {NORM('text')} AS norm FROM mem) SELECT id, {key_sql('norm')} AS key, md5({value_sql('norm')}) AS value FROM n")
def statement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ("embeddings",))
    return rows.select("id", tx.statement_key(F.col("text")).alias("key"), F.md5(tx.statement_value(F.col("text")).cast("binary")).alias("value"))


PAIRS = f"""WITH {MEMORY_SQL}, p AS (SELECT n.id AS new_id, m.id AS old_id, n.text AS new_text, m.text AS old_text, (epoch(n.created_at) - epoch(m.created_at)) / 3600.0 AS age, {COS.replace('p.', 'n.')} AS sim
  FROM mem n JOIN mem m ON m.user_id = n.user_id AND m.id <> n.id AND m.embedding IS NOT NULL AND n.embedding IS NOT NULL AND n.created_at >= m.created_at AND epoch(n.created_at) - epoch(m.created_at) <= 72 * 3600),
c AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id)::INTEGER AS rank FROM p)"""


@R.query(PAIRS + " SELECT new_id, old_id, rank, round(sim, 6) AS similarity FROM c WHERE rank <= 5")
def write_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(memory_units(spark, sf_dir, ("embeddings",)).where(F.col("embedding").isNotNull()).select("id", "user_id", "embedding", "created_at"))
    return ar.nearest(rows, rows).select("new_id", "old_id", "rank", F.round("similarity", 6).alias("similarity"))


ANCHORS = lambda t: f"list_sort(list_distinct(list_concat(list_concat(regexp_extract_all({t}, '\\b[A-Z]{{2,6}}-[0-9]+\\b'), regexp_extract_all({t}, '\\b[\\w/.-]+\\.[a-z]{{1,4}}:[0-9]+\\b')), regexp_extract_all({t}, '#[0-9]+\\b'))))"
TOKS = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
OPPOSING = " OR ".join(f"(list_contains(ot, '{a}') AND list_contains(nt, '{b}')) OR (list_contains(ot, '{b}') AND list_contains(nt, '{a}'))" for a, b in ar.STATES)


@R.query(PAIRS + f""", k AS (SELECT *, {NORM('new_text')} AS nn, {NORM('old_text')} AS no FROM c WHERE rank <= 5),
v AS (SELECT *, {key_sql('nn')} AS kn, {key_sql('no')} AS ko, {value_sql('nn')} AS vn, {value_sql('no')} AS vo, {ANCHORS('new_text')} AS an, {ANCHORS('old_text')} AS ao, {TOKS('new_text')} AS nt, {TOKS('old_text')} AS ot FROM k),
s AS (SELECT *, ko <> '' AND ko = kn AND (({OPPOSING}) OR (vo <> '' AND vn <> '' AND vo <> vn AND NOT contains(vo, vn) AND NOT contains(vn, vo))) AS corrects, len(an) > 0 AND len(ao) > 0 AND an <> ao AS conflict FROM v),
b AS (SELECT *, CASE WHEN nn = no AND age <= 24 THEN '1_skip_exact' WHEN sim >= 0.85 AND age <= 72 AND corrects AND NOT conflict THEN '2_supersede' WHEN sim >= 0.95 AND age <= 24 AND NOT conflict THEN '3_skip_near'
  WHEN sim >= 0.85 AND age <= 72 AND conflict THEN '6_create' WHEN sim >= 0.85 AND age <= 72 AND contains(no, nn) THEN '4_skip_contained' WHEN sim >= 0.85 AND age <= 72 THEN '5_merge' ELSE '6_create' END AS band FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY band, sim DESC, old_id) AS j FROM b)
SELECT m.id, coalesce(band, '6_create') AS decision, CASE WHEN coalesce(band, '6_create') <> '6_create' THEN old_id END AS target FROM mem m LEFT JOIN f ON f.new_id = m.id AND j = 1 WHERE m.embedding IS NOT NULL""")
def arbitration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder at its own thresholds; a test runs its bands on planted near copies."""
    rows = written(memory_units(spark, sf_dir, ("embeddings",)).where(F.col("embedding").isNotNull()).select("id", "user_id", "text", "embedding", "created_at"))
    return ar.decide(ar.nearest(rows, rows), rows, store=rows)


@R.query(f"WITH {MEMORY_SQL}, n AS (SELECT id, {NORM('text')} AS norm FROM mem) SELECT min(id) AS first_id, count(*) AS n FROM n GROUP BY norm HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_units(spark, sf_dir, ()).select("id", F.sha2(tx.normalised(F.col("text")), 256).alias("k"))
    return rows.groupBy("k").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("k")


@R.query(f"WITH {MEMORY_SQL} SELECT id, coalesce(nullif(regexp_extract(text, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), ''), nullif(regexp_extract(text, '\\bQ[1-4] ?[0-9]{{4}}\\b'), ''), nullif(regexp_extract(text, '\\b(?:19|20)[0-9]{{2}}\\b'), '')) AS occasion FROM mem")
def occasion_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", ar.occasion(F.col("text")).alias("occasion"))


@R.query(f"WITH {MEMORY_SQL} SELECT id, {ANCHORS('text')} AS anchors FROM mem")
def referent_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_units(spark, sf_dir, ()).select("id", ar.anchors(F.col("text")).alias("anchors"))


TURNS = "t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS old FROM conversations)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    old = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, sf_dir, "conversations").withColumn("old", old).where("old is not null")


@R.query(f"WITH {TURNS}, x AS (SELECT conv_id, turn, list_distinct({TOKS('text')}) AS n, {TOKS('old')} AS o FROM t WHERE old IS NOT NULL), y AS (SELECT conv_id, turn, len(list_filter(n, lambda z: NOT list_contains(o, z))) AS k, greatest(len(n), 1) AS d FROM x) SELECT conv_id, turn, k >= 3 AND k / d >= 0.40 AS additive FROM y")
def additive_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", ar.additive(F.col("old"), F.col("text")).alias("additive"))


@R.query()
def merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence splitting looks behind, which RE2 cannot; tested on small rows."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", ar.merged_text(F.col("old"), F.col("text")).alias("merged"))


@R.query()
def near_pairs_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs: at this threshold hyperplane buckets prune little. No twin; tested against brute force."""
    return ar.near_pairs(memory_units(spark, sf_dir, ("embeddings",)).select("user_id", "id", "embedding"), "user_id", 0.35).withColumn("similarity", F.round("similarity", 6))
