"""Row shaping: depth rendering, envelopes and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx


def at_depth(depth: str, l0: int = 100) -> Column:
    """l0: the start of the text; l1: its first sentence; full: all of it."""
    text = F.col("text")
    return {"l0": F.substring(text, 1, l0), "l1": tx.first_sentence(text), "full": text}[depth]


def envelope(rows: DataFrame, by: list[str]) -> DataFrame:
    """One block of untrusted lines per group, in rank order. Groups are one query's hits: bounded by k."""
    lines = F.array_sort(F.collect_list(F.struct("rank", tx.sanitised(F.col("text")).alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit("<memories untrusted=\"true\">\n"), body, F.lit("\n</memories>")).alias("block"))


def budget_fit(rows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """The deepest rendering (full, l1, l0) whose sum fits the group's token budget; if none does, l0 rows
    from the first on while they fit."""
    group = Window.partitionBy(*by)
    cost = {d: tx.token_estimate(at_depth(d)) for d in ("full", "l1", "l0")}
    known = rows.withColumns({f"t_{d}": c for d, c in cost.items()}).withColumns({f"s_{d}": F.sum(F.col(f"t_{d}")).over(group) for d in cost})
    depth = F.when(F.col("s_full") <= budget, "full").when(F.col("s_l1") <= budget, "l1").otherwise("l0")
    spent = F.sum(F.when(F.col("depth") == "full", F.col("t_full")).when(F.col("depth") == "l1", F.col("t_l1")).otherwise(F.col("t_l0"))).over(group.orderBy("rank"))
    chosen = known.withColumn("depth", depth).withColumn("spent", spent).where(F.col("spent") <= budget)
    text = F.when(F.col("depth") == "full", at_depth("full")).when(F.col("depth") == "l1", at_depth("l1")).otherwise(at_depth("l0"))
    return chosen.withColumn("text", text).drop(*[f"{p}_{d}" for p in "ts" for d in cost])


def path_quota(rows: DataFrame, by: list[str], path: str, k: int) -> DataFrame:
    """The top k with rows of the path first; rows without a path fill up, but at most one of them if the
    path's own are half of k or more."""
    group = Window.partitionBy(*by)
    kind = F.when(F.col("path") == path, "exact").when(F.col("path").isNull(), "none").otherwise("other")
    known = rows.withColumn("kind", kind).where("kind <> 'other'")
    known = known.withColumn("exact", F.count_if(F.col("kind") == "exact").over(group)).withColumn("place", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("rank")))
    fits = (F.col("kind") == "exact") | (F.col("exact") * 2 < k) | (F.col("place") == 1)
    kept = known.where(fits).withColumn("place", F.row_number().over(group.orderBy(F.col("kind"), "rank")))
    return kept.where(F.col("place") <= k).drop("kind", "exact")


def redacted(text: Column) -> Column:
    """Mail addresses, keys and home folders elided, for exports."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(F.regexp_replace(mail, r"\b(AKIA[A-Z0-9]{16}|[0-9a-f]{32,})\b", "[key]"), r"/(home|Users)/[^/\s]+", "~")
