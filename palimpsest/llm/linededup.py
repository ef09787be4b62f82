"""Line dedup: overlapping windows of three lines, repeated windows found globally.

Every three consecutive lines with a word in them (blank lines between are skipped) are hashed to
128 bits. A window that occurs more than once in the corpus has a first occurrence, by doc_id, then
text hash, then position; the lines of all later occurrences are covered, and a document's covered
positions, merged, are removed from its text. An occurrence that overlaps the first one in the same
document isn't a later one, so that a run of equal lines keeps its first three.

Only DataFrame operations. The windows are written once; the first occurrences are aggregated map-side
before their shuffle; the join back has one row per window on one side, so that a frequent window
is split by adaptive skew handling.

Edge cases: a null text stays null, an empty one empty; texts of fewer than three lines with a word
stay as they are; rows that are equal in doc_id and text count as one document, whose windows
occur once (all copies of the row stay alike); a null doc_id sorts first and is told apart by the
text; an empty table gives an empty result; columns other than doc_id and text pass through, whatever
their names (n_lines and n_removed alone are replaced); a text of any length is one row's array of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import let, materialize

HAS_WORD = r"[^\x20\x09-\x0D]"


def line_windows(text: Column) -> Column:
    """Array of (i: index among lines with a word, p0..p2: line positions, h1, h2: hash)."""

    def windows(lines: Column) -> Column:
        first, second, third = (lambda i, k=k: F.get(lines, i + k) for k in range(3))

        def window(x: Column, i: Column) -> Column:
            a, b, c = first(i), second(i), third(i)
            return F.struct(
                i.alias("i"), a["pos"].alias("p0"), b["pos"].alias("p1"), c["pos"].alias("p2"),
                F.xxhash64(a["line"], b["line"], c["line"]).alias("h1"), F.xxhash64(F.lit("w"), c["line"], a["line"], b["line"]).alias("h2"),
            )

        return F.slice(F.transform(lines, window), F.lit(1), F.greatest(F.size(lines) - 2, F.lit(0)))

    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("pos"), line.alias("line"))),
        lambda x: x["line"].rlike(HAS_WORD),
    )
    return let(lines, windows)


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered: line positions to remove), for documents with any."""
    windows = materialize(
        docs.where(F.col("text").isNotNull())
        .select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), line_windows(F.col("text")).alias("w"))
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", F.inline("w"))
    )
    place = F.struct("doc_id", "text_hash", "i")
    firsts = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    same_document = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = windows.join(firsts, ["h1", "h2"]).where(~(same_document & (F.col("i") < F.col("first.i") + 3)))
    return later.select("doc_id", "text_hash", F.explode(F.array("p0", "p1", "p2")).alias("p")).groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text of every row cut, and n_lines, n_removed: its lines, and those removed."""
    covered = covered_lines(docs)
    # the row travels as one struct, so that its columns' names meet no other
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.col("text").alias("old"), F.xxhash64("text").alias("row_hash"))
    joined = rows.join(covered, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")), "left")

    def cut(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    n_lines = F.when(F.col("old").isNull(), 0).otherwise(F.length("old") - F.length(F.replace("old", F.lit("\n"), F.lit(""))) + 1)
    text = F.when(F.col("covered").isNull(), F.col("old")).otherwise(let(F.split("old", "\n"), cut))
    kept = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*kept, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
split AS (SELECT rid, doc_id, string_split(text, chr(10)) AS lines FROM rows),
numbered AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM split),
worded AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS i FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT rid, doc_id, i, pos AS p0, lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM worded WINDOW w AS (PARTITION BY rid ORDER BY i)),
ranked AS (
  SELECT *, count(*) OVER g AS n, first_value(rid) OVER o AS f_rid, first_value(i) OVER o AS f_i
  FROM windows WHERE p2 IS NOT NULL
  WINDOW g AS (PARTITION BY a, b, c), o AS (PARTITION BY a, b, c ORDER BY doc_id, i)),
later AS (SELECT * FROM ranked WHERE n > 1 AND NOT (rid = f_rid AND i < f_i + 3)),
covered AS (SELECT rid, p0 AS p FROM later UNION SELECT rid, p1 FROM later UNION SELECT rid, p2 FROM later),
kept AS (
  SELECT n.rid, string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE c.p IS NULL) AS new_text, count(*) AS n_lines, count(c.p) AS n_removed
  FROM numbered n LEFT JOIN covered c ON c.rid = n.rid AND c.p = n.pos GROUP BY n.rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.new_text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN rows r ON r.doc_id = d.doc_id AND r.text = d.text LEFT JOIN kept k ON k.rid = r.rid
"""
