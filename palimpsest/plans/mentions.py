"""Entities that conversations mention, and queries widened by facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import mentions as mn
from palimpsest.plans.recall_many import STOP_SQL, TOKENS_SQL, asked, kept_sql
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import MEMORY_SQL, memory_units, table

R = Registry()


def name_sql(text: str) -> str:
    folded = rf"translate(lower(regexp_replace({text}, '\p{{M}}', '', 'g')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return rf"trim(regexp_replace(regexp_replace({folded}, '[^\p{{L}}\p{{N}}\s-]', '', 'g'), '\s+', ' ', 'g'))"


RUNS_SQL = " || ".join(f"list_transform(range(1, len(words) - {size - 1} + 1), lambda i: array_to_string(words[i:i + {size - 1}], ' '))" for size in (4, 3, 2, 1))
#: What a text mentions isn't cut, nor are the entities of a name: these are listed once, in rows without a turn.
MENTIONS_SQL = f"""c0 AS (SELECT conv_id, turn, text, list_filter({TOKENS_SQL.format(text='text')}, lambda x: NOT list_contains({STOP_SQL}, x)) AS words,
  list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^\\p{{Lu}}')), lambda x: {name_sql('x')}), lambda x: len(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS names
  FROM conversations WHERE text IS NOT NULL),
c1 AS (SELECT conv_id, turn, list_filter([{name_sql('text')}] || names || list_transform({RUNS_SQL}, lambda x: {name_sql('x')}), lambda x: len(x) >= 3) AS l FROM c0),
asked AS (SELECT DISTINCT conv_id, turn, unnest(l) AS mention FROM c1),
words AS (SELECT doc_id AS entity, {TOKENS_SQL.format(text='text')} AS t FROM documents),
entity AS (SELECT entity, array_to_string(t[1:2], ' ') AS name_norm, list_distinct(t[3:3]) AS aliases_norm FROM words),
dict AS (SELECT * FROM (SELECT entity, name_norm AS mention, 'name' AS via FROM entity UNION SELECT entity, unnest(aliases_norm), 'alias' FROM entity) WHERE len(mention) >= 3),
called AS (SELECT mention, via, min(entity) AS entity, count(*) AS entities FROM dict GROUP BY ALL)"""


@R.query(f"WITH {MENTIONS_SQL} SELECT conv_id, turn, entity, mention, via, entities FROM asked JOIN called USING (mention) UNION ALL SELECT NULL, NULL, entity, mention, via, NULL FROM dict")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an entity, named by its first two words, its third an alias; all turns are asked for all that
    they mention. Rows without a turn list which entities have a name."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.slice(tx.tokens(F.col("text")), 1, 3).alias("t"))
    entities = words.select("entity", F.array_join(F.slice("t", 1, 2), " ").alias("name_norm"), F.slice("t", 3, 1).alias("aliases_norm"))
    return mn.linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), entities, ["conv_id", "turn"])


FACETS = [("f0", ["which", "value", "the"], ["exact number", "passage"]), ("f1", ["anle", "passage", "entar", "tion"], ["language tion", "value", "page of text"]), ("f2", ["der", "que", "value"], ["number", "sprache", "last term"])]
FACETS_SQL = """facets AS (SELECT * FROM (VALUES ('f0', ['which', 'value', 'the'], ['exact number', 'passage']), ('f1', ['anle', 'passage', 'entar', 'tion'], ['language tion', 'value', 'page of text']),
  ('f2', ['der', 'que', 'value'], ['number', 'sprache', 'last term'])) t(facet, signals, terms))"""


@R.query(f"""WITH RECURSIVE {MEMORY_SQL}, {FACETS_SQL}, q AS (SELECT id AS query_id, CASE WHEN id % 200 = 0 THEN 'which value is ' ELSE '' END || substr(text, 1, 100) AS q_text FROM mem WHERE id % 100 = 0),
qt AS (SELECT query_id, unnest({kept_sql(TOKENS_SQL.format(text='q_text'), STOP_SQL)}) AS term FROM q),
hit AS (SELECT DISTINCT query_id, facet FROM qt JOIN (SELECT facet, unnest(signals) AS term FROM facets) USING (term)),
offers AS (SELECT query_id, word, {TOKENS_SQL.format(text='word')} AS own, row_number() OVER (PARTITION BY query_id ORDER BY pos, facet) AS k FROM (SELECT query_id, facet, unnest(terms) AS word, generate_subscripts(terms, 1) AS pos FROM hit JOIN facets USING (facet))),
walk AS (SELECT query_id, 0 AS k, []::VARCHAR[] AS added, {TOKENS_SQL.format(text='q_text')} AS there FROM q
  UNION ALL SELECT w.query_id, o.k, CASE WHEN fresh THEN list_append(added, word) ELSE added END, CASE WHEN fresh THEN there || own ELSE there END
  FROM (SELECT w.*, o.k AS next, o.word, o.own, len(added) < 4 AND len(list_filter(o.own, lambda x: NOT list_contains(there, x))) > 0 AS fresh FROM walk w JOIN offers o ON o.query_id = w.query_id AND o.k = w.k + 1) w
  JOIN (SELECT query_id, k FROM offers) o ON o.query_id = w.query_id AND o.k = w.next),
last AS (SELECT query_id, arg_max(added, k) AS added FROM walk GROUP BY query_id)
SELECT query_id, CASE WHEN len(added) > 0 THEN q_text || E'\\n' || array_to_string(added, ' ') ELSE q_text END AS expanded FROM q JOIN last USING (query_id)""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = spark.createDataFrame(FACETS, "facet string, signals array<string>, terms array<string>")
    return mn.expanded(asked(memory_units(spark, sf_dir)).select("query_id", "text"), facets).select("query_id", "expanded")
