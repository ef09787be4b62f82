"""Records over their life: writes that supersede, forget or restore, and the filters and reads around them.

Changes are DataFrames of ids; a change is one join of the records with its small keyed table, and the result
is the whole new state of the records, to be written as a table or a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors as vec
from palimpsest.operators.stored import written

# Thresholds and factors.
NOISE_RETRIEVED, DRIFT, NOVELTY_K, OVERLAP, PREFERRED, OTHER = 3, 0.05, 10, 0.5, 1.08, 0.72


def supersede(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records(id, user_id, active, lineage_root) after decisions(new_id, old_id, user_id): the old record turns
    inactive and names its successor, the new one turns active, names what it supersedes and carries the old
    one's lineage root. A decision for itself, for a missing record or for another tenant's changes nothing;
    of several decisions for one old record the smallest new id wins, and the reverse."""
    known = records.select("id", "user_id", "lineage_root")
    old = known.select(F.col("id").alias("old_id"), F.col("user_id").alias("old_user"), F.coalesce("lineage_root", "id").alias("root"))
    new = known.select(F.col("id").alias("new_id"), F.col("user_id").alias("new_user"))
    valid = decisions.where("new_id <> old_id").join(old, "old_id").join(new, "new_id").where("old_user = user_id and new_user = user_id")
    first = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(other))
    valid = valid.withColumn("k", first("old_id", "new_id")).where("k = 1").withColumn("k", first("new_id", "old_id")).where("k = 1")
    gone = valid.select(F.col("old_id").alias("id"), F.col("new_id").alias("superseded_by"))
    come = valid.select(F.col("new_id").alias("id"), F.col("old_id").alias("supersedes"), "root")
    joined = records.join(gone, "id", "left").join(come, "id", "left")
    active = F.when(F.col("superseded_by").isNotNull(), False).when(F.col("supersedes").isNotNull(), True).otherwise(F.col("active"))
    return joined.withColumns({"active": active, "lineage_root": F.coalesce("root", "lineage_root")}).drop("root")


def forget(records: DataFrame, wanted: DataFrame, hard: bool = False) -> DataFrame:
    """records without, or with inactive, rows for wanted(id, user_id); other tenants' ids change nothing."""
    if hard:
        return records.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_anti")
    marked = records.join(wanted.select("id", "user_id", F.lit(True).alias("hit")).distinct(), ["id", "user_id"], "left")
    return marked.withColumns({"active": F.when(F.col("hit"), False).otherwise(F.col("active")), "inactive_reason": F.when(F.col("hit"), "forgotten").otherwise(F.col("inactive_reason"))}).drop("hit")


def restore(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """records whose wanted(id, user_id) rows that aren't active, or say nothing, are active again."""
    marked = records.join(wanted.select("id", "user_id", F.lit(True).alias("asked")).distinct(), ["id", "user_id"], "left")
    hit = F.col("asked") & ~F.coalesce("active", F.lit(False))
    return marked.withColumns({"active": F.when(hit, True).otherwise(F.col("active")), "inactive_reason": F.when(hit, None).otherwise(F.col("inactive_reason"))}).drop("asked")


def invalidated(records: DataFrame, roles: list[str], now: Column, path: str | None = None) -> DataFrame:
    """Records of these roles (and this path) that are still valid are invalid from now on."""
    hit = F.col("memory_role").isin(roles) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > now))
    if path is not None:
        hit = hit & (F.col("path") == path)
    return records.withColumn("invalid_at", F.when(hit, now).otherwise(F.col("invalid_at")))


def not_stale(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def attributed(path: str | None = None, client: str | None = None) -> Column:
    """Rows of the path and the client; what isn't given is not asked for."""
    condition = F.lit(True)
    if path:
        condition = condition & (F.col("path") == path)
    if client:
        condition = condition & (F.col("client") == client)
    return condition


def learned_noise() -> Column:
    """Retrieved for status questions often enough and never used; null counters never match."""
    return (F.col("status_retrieved") >= NOISE_RETRIEVED) & (F.col("used") == 0) & F.coalesce("active", F.lit(True))


def prefer_client(hits: DataFrame, client: str | None, mode: str) -> DataFrame:
    """none - as they are; strict - the client's rows alone; prefer - its rows count for more, others for less."""
    if not client or mode == "none":
        return hits
    if mode == "strict":
        return hits.where(F.col("client") == client)
    factor = F.when(F.coalesce(F.col("client"), F.lit("")) == "", 1.0).when(F.col("client") == client, PREFERRED).otherwise(OTHER)
    return hits.withColumn("score", F.col("score") * factor)


def resolved_tier(category: Column, confidence: Column) -> Column:
    sure = category.isin("cases", "events") & (confidence >= 0.9)
    return F.when(category.isin("profile", "preferences"), "durable").when(confidence < 0.5, "ephemeral").when(sure, "durable").otherwise("working")


def drift(counts: DataFrame) -> DataFrame:
    """counts(committed, indexed) with the share that isn't indexed, whether it is too large, and whether the
    index holds no more than was committed."""
    ratio = F.when(F.col("committed") == 0, 0.0).otherwise((F.col("committed") - F.col("indexed")) / F.col("committed"))
    return counts.withColumns({"ratio": ratio, "breach": ratio > DRIFT, "holds": F.col("committed") >= F.col("indexed")})


def novelty(queries: DataFrame, memories: DataFrame, k: int = NOVELTY_K) -> DataFrame:
    """(query_id, nearest, novelty): the k most similar active memories of the query's user and scope, but not of its
    session and never global ones; 1 less the best cosine, 1 where there is none. Queries are a stated set."""
    side = queries.select(F.col("id").alias("query_id"), "user_id", "scope", F.col("session_id").alias("query_session"), F.col("embedding").alias("q"))
    rows = memories.where((F.col("scope") != "global") & (F.col("active") == True)).select("id", "user_id", "scope", "session_id", "embedding")  # noqa: E712
    met = side.join(rows, ["user_id", "scope"]).where("session_id <> query_session")
    scored = met.select("query_id", "id", F.coalesce(vec.cosine(F.col("q"), F.col("embedding")), F.lit(0.0)).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    near = scored.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).groupBy("query_id").agg(F.count("*").alias("nearest"), F.max("similarity").alias("best"))
    return side.select("query_id").join(near, "query_id", "left").select("query_id", F.coalesce("nearest", F.lit(0)).alias("nearest"), (1 - F.coalesce("best", F.lit(0.0))).alias("novelty"))


def reconciled(candidates: DataFrame, members: DataFrame, least: float = OVERLAP, most_ids: int = 64, most_clusters: int = 256) -> DataFrame:
    """candidates(group, id), members(cluster, id): for each group the existing cluster that holds most of its ids, if
    it holds `least` of them; ties go to the first cluster. An id's clusters travel as one array to each group
    that has it and are counted there; groups of more than `most_ids` ids, or with an id of more than `most_clusters`
    clusters, are counted by rows, so that no array grows with the tables."""
    members = written(members.where("id is not null").select("id", "cluster").distinct())
    sized = candidates.where("group is not null").distinct().groupBy("group").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    sizes = members.groupBy("id").agg(F.count("*").alias("clusters"))
    wide = written(sizes.where(F.col("clusters") > most_clusters).select("id"))
    asked = written(sized.select("group", "n", F.explode("ids").alias("id")))
    large = written(asked.where(F.col("n") > most_ids).select("group").unionByName(asked.join(wide, "id", "left_semi").select("group")).distinct())
    held = members.join(wide, "id", "left_anti").groupBy("id").agg(F.collect_list("cluster").alias("clusters"))
    met = asked.join(large, "group", "left_anti").join(held, "id").groupBy("group", "n").agg(F.flatten(F.collect_list("clusters")).alias("clusters"))
    kinds = {**{f.name: f.dataType.simpleString() for f in asked.schema}, **{f.name: f.dataType.simpleString() for f in members.schema}}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cluster, code = np.unique(np.concatenate(rows["clusters"].to_numpy()), return_inverse=True)
            row = np.repeat(np.arange(len(rows)), rows["clusters"].map(len).to_numpy())
            pair, overlap = np.unique(row * len(cluster) + code, return_counts=True)
            row, code = np.divmod(pair, len(cluster))
            # in order of row and cluster: the first of a row's largest
            order = np.lexsort((code, -overlap, row))
            row, code, overlap = row[order], code[order], overlap[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            first = first[overlap[first] >= least * rows["n"].to_numpy()[row[first]]]
            yield pd.DataFrame({"group": rows["group"].to_numpy()[row[first]], "cluster": cluster[code[first]], "overlap": overlap[first]})

    found = met.mapInPandas(count, f"group {kinds['group']}, cluster {kinds['cluster']}, overlap long")
    if large.isEmpty():
        return found
    rest = asked.join(large, "group", "left_semi").join(members, "id")
    common = rest.groupBy("group", "n", "cluster").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least * F.col("n"))
    best = Window.partitionBy("group").orderBy(F.desc("overlap"), "cluster")
    return found.unionByName(common.withColumn("k", F.row_number().over(best)).where("k = 1").select("group", "cluster", "overlap"))


def synthesis_ready(clusters: DataFrame, least: int = 3, new: int = 2) -> Column:
    """Large enough, no singleton, and grown since its last note, if there is one."""
    grown = F.col("last_count").isNull() | (F.col("size") - F.col("last_count") >= new)
    return (F.col("size") >= least) & (F.col("method") != "singleton") & grown


def state_of_path(states: DataFrame, by: list[str], path: str) -> DataFrame:
    """One state for each group: that of the path, else one without a path, else any; the newest of them."""
    turn = F.when(F.col("path") == path, 0).when(F.col("path").isNull(), 1).otherwise(2)
    first = Window.partitionBy(*by).orderBy(turn, F.desc("created_at"), "id")
    return states.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def upserted_gaps(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """existing(gap, status, n, score), seen(gap, n, score): counts add up, the higher score stays, and a status that
    was set stays; new gaps are open."""
    both = existing.select("gap", "status", "n", "score").unionByName(seen.select("gap", F.lit(None).cast("string").alias("status"), "n", "score"))
    return both.groupBy("gap").agg(F.coalesce(F.max("status"), F.lit("open")).alias("status"), F.sum("n").alias("n"), F.max("score").alias("score"))
