"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a domain - language - source tree. Among siblings it is dealt in
proportion to their weights, but no node gets more than its leaves can give (their tokens times the
epochs allowed); what a node cannot use goes to its siblings first, in proportion to their
weights, and only when all of them are full to the parent's siblings. Weights belong to a node's
path, so that a source may have different ones below two languages; a node without one weighs 1. Each leaf then takes a prefix of its
seeded epochs: epoch e is the leaf's documents in the order of md5(seed:e:doc_id), and epochs
follow each other until the leaf's budget is reached.

Only DataFrame operations, in whole numbers. The tree has a row per node, never per document. A
leaf's prefix is found by summing tokens over 4,096 ranges of the order (aggregated map-side); only
the one range in which the budget ends is ordered row by row, so that a source that holds a third
of all rows is never in one task.

Edge cases: a null text has no tokens (and goes with its place in the order); a null domain, language or
source is the node `(none)`; rows that share a doc_id share their place, and enter together or not
at all; a leaf without tokens has no budget to spend, and none of its documents are taken; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACES, materialize

LEVELS = ("domain", "lang", "source")
#: The registered target weights, by path down the tree.
WEIGHTS: dict[tuple[str, ...], int] = {
    ("d0",): 3, ("d1",): 2, ("d3",): 5,
    ("d0", "en"): 4, ("d0", "de"): 2, ("d1", "en"): 1, ("d1", "fr"): 3, ("d2", "es"): 2, ("d3", "en"): 2, ("d3", "de"): 3,
    ("d0", "en", "src0"): 3, ("d0", "en", "src4"): 1, ("d0", "de", "src4"): 5, ("d1", "fr", "src1"): 2, ("d2", "es", "src2"): 4, ("d3", "de", "src7"): 2,
}
WHOLE = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Words of the text: runs of characters other than white space."""
    trimmed = F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def domain(source: Column) -> Column:
    """The tables have no domain: one of four, by the source's last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 4).cast("string"))


def water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes(parents.., name, cap, weight, pool) with `budget`: each parent's pool among its children.

    In the order of cap / weight the full children are a prefix: a child is full if its cap is
    within its share of what those before it leave."""
    siblings = Window.partitionBy(*parents)
    order = siblings.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0)).cast(WHOLE)
    known = nodes.withColumns({"w_all": F.sum("weight").over(siblings).cast(WHOLE), "w_before": prior("weight"), "c_before": prior("cap")})
    left, share = F.col("pool") - F.col("c_before"), F.col("w_all") - F.col("w_before")
    full = known.withColumn("full", (left > 0) & (F.col("cap") * share <= F.col("weight") * left))
    summed = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(siblings), F.lit(0)).cast(WHOLE)
    totals = full.withColumns({"c_full": summed("cap"), "w_full": summed("weight")})
    part = F.expr("(weight * greatest(pool - c_full, cast(0 as decimal(38,0)))) div (w_all - w_full)")
    return totals.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part).cast(WHOLE)).drop("w_all", "w_before", "c_before", "full", "c_full", "w_full", "pool")


Weights = dict[tuple[str, ...], int]


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, weights: Weights | None = None) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget`; weights: by path, 1 where none is given."""
    levels = list(LEVELS)
    parents: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        given = {names: w for names, w in (weights or {}).items() if len(names) == depth + 1}
        here = lambda names, path=path: reduce(and_, [F.col(c) == name for c, name in zip(path, names, strict=True)])
        weight = reduce(lambda c, kv, here=here: F.when(here(kv[0]), kv[1]).otherwise(c), given.items(), F.lit(1))
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast(WHOLE).alias("cap")).withColumn("weight", weight.cast(WHOLE))
        if parents is None:
            total = F.sum("cap").over(Window.partitionBy())
            nodes = nodes.withColumn("total", total.cast(WHOLE)).withColumn("total", F.expr(f"total div {epochs}")).withColumn("pool", budget.cast(WHOLE)).drop("total")
        else:
            nodes = nodes.join(parents, path[:-1])
        filled = water_fill(nodes, path[:-1], level)
        parents = filled.select(*path, F.col("budget").alias("pool"))
    return leaves.join(parents.withColumnRenamed("pool", "budget"), levels)


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 2, weights: Weights | None = None, seed: int = 7, domain_of: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of the documents taken: copies counts the epochs
    in which a document is in its leaf's prefix. The budget is share x all tokens, in thousandths."""
    levels = list(LEVELS)
    none = F.lit("(none)")
    node = domain(F.col("source")) if domain_of is None else domain_of
    rows = materialize(docs.select("doc_id", F.coalesce(node, none).alias("domain"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), tokens(F.col("text")).alias("tokens")))
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    total = F.expr(f"(total * {round(share * 1000)}) div 1000")
    plan = (
        leaf_budgets(leaves, total, epochs, weights)
        .where("tokens > 0")
        .withColumn("whole", F.expr("budget div tokens").cast("int"))
        .select(*levels, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).cast("long").alias("rest"))
    )
    plan = materialize(plan)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.join(plan, levels).withColumn("place", place).withColumn("range", F.substring("place", 1, 3))
    ranges = placed.groupBy(*levels, "range").agg(F.sum("tokens").alias("in_range"))
    before = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    known = placed.join(ranges, [*levels, "range"])
    inside = Window.partitionBy(*levels, "range").orderBy("place")
    clear = known.where("ahead + in_range <= rest or ahead >= rest").withColumn("last", (F.col("ahead") + F.col("in_range") <= F.col("rest")).cast("int"))
    split = known.where("ahead + in_range > rest and ahead < rest").withColumn("upto", F.sum("tokens").over(inside)).withColumn("last", (F.col("ahead") + F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    taken = clear.unionByName(split).withColumn("copies", (F.col("whole") + F.col("last")).cast("int"))
    return taken.where("copies > 0").select("doc_id", *levels, "tokens", "copies")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """Rows of docs, each as often as the mixture takes it."""
    taken = mix(docs, **params).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"))
    joined = rows.join(taken, F.col("row_id").eqNullSafe(F.col("taken_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def oracle(share_thousandths: int = 500, epochs: int = 2, seed: int = 7, weights: Weights | None = None) -> str:
    def weight(depth: int) -> str:
        given = [(names, w) for names, w in (weights or {}).items() if len(names) == depth]
        whens = " ".join(f"WHEN {' AND '.join(f'{c} = {chr(39)}{name}{chr(39)}' for c, name in zip(LEVELS, names))} THEN {w}" for names, w in given)
        return f"CASE {whens} ELSE 1 END" if given else "1"

    def fill(path: list[str], parent: str, before: str) -> str:
        on = ", ".join(path[:-1])
        by = f"PARTITION BY {on}" if on else ""
        pool = f"SELECT n.*, p.budget AS pool FROM nodes_{len(path)} n JOIN {parent} p USING ({on})" if on else f"SELECT n.*, (t.total * {share_thousandths}) // 1000 AS pool FROM nodes_1 n, {parent} t"
        order = f"({by} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""
a{len(path)} AS (SELECT *, sum(weight) OVER ({by}) AS w_all, coalesce(sum(weight) OVER {order}, 0) AS w_before, coalesce(sum(cap) OVER {order}, 0) AS c_before FROM ({pool})),
b{len(path)} AS (SELECT *, pool - c_before > 0 AND cap * (w_all - w_before) <= weight * (pool - c_before) AS filled FROM a{len(path)}),
c{len(path)} AS (SELECT *, coalesce(sum(cap) FILTER (WHERE filled) OVER ({by}), 0) AS c_full, coalesce(sum(weight) FILTER (WHERE filled) OVER ({by}), 0) AS w_full FROM b{len(path)}),
budget_{len(path)} AS (SELECT {", ".join(path)}, cap, CASE WHEN filled THEN cap ELSE weight * greatest(pool - c_full, 0) // (w_all - w_full) END AS budget FROM c{len(path)})"""

    levels = list(LEVELS)
    nodes = ",\n".join(f"nodes_{k} AS (SELECT {', '.join(levels[:k])}, sum(tokens) * {epochs} AS cap, {weight(k)} AS weight FROM rows GROUP BY ALL)" for k in (1, 2, 3))
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce('d' || (ascii(right(source, 1)) % 4), '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
total AS (SELECT sum(tokens) AS total FROM rows),
{nodes},
{fill(levels[:1], "total", "")},
{fill(levels[:2], "budget_1", "")},
{fill(levels, "budget_2", "")},
leaf AS (SELECT domain, lang, source, budget // tokens AS whole, budget - (budget // tokens) * tokens AS rest
  FROM budget_3 JOIN (SELECT domain, lang, source, sum(tokens) AS tokens FROM rows GROUP BY ALL) USING (domain, lang, source) WHERE tokens > 0),
placed AS (SELECT r.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM rows r JOIN leaf USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM placed)
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM run WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


ORACLE = oracle(weights=WEIGHTS)
