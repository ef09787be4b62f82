"""Lifecycle maintenance: decay, pruning, promotion, usefulness, deduplication, lineage, sessions and gaps.

`now` is an argument everywhere. What the reference writes back row by row is here the changed
rows' new values, to be merged by key (see `merge`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

# Half-lives in hours, thresholds and weights.
HALF_LIFE_HOURS = {"ephemeral": 3.0, "working": 48.0, "durable": 672.0}
ACCESS_HALF_LIFE = 168.0
PRUNE = {"vitality": 0.10, "days": 30, "confidence": 0.7, "share": 0.05}


def clamp(c: Column, absent: float = 0.0) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(absent)), F.lit(0.0)), F.lit(1.0))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_seconds(end) - F.unix_seconds(start)) / 3600.0


def vitality(now: Column) -> Column:
    """Mean of recency, access and confidence; 1 for pinned rows."""
    half = F.lit(HALF_LIFE_HOURS["working"])
    for tier, hours in HALF_LIFE_HOURS.items():
        half = F.when(F.col("tier") == tier, hours).otherwise(half)
    hours = hours_between(F.coalesce("last_accessed_at", "created_at"), now)
    recency = F.pow(F.lit(0.5), hours / half)
    access = F.least(F.lit(1.0), F.col("access_count") / 5.0)
    return F.when(F.col("pinned"), 1.0).otherwise((recency + access + clamp(F.col("confidence"))) / 3.0)


def prune(memories: DataFrame, by: list[str], now: Column) -> DataFrame:
    """Ids to inactivate: the least vital eligible rows of each tenant, at most five in a hundred of its
    active ones. Counts are aggregated; only eligible rows, few by rule, are ordered."""
    active = memories.where(F.coalesce("active", F.lit(True)))
    limits = active.groupBy(*by).agg(F.floor(F.count("*") * PRUNE["share"]).alias("most"))
    old = hours_between(F.col("created_at"), now) > PRUNE["days"] * 24
    eligible = active.withColumn("vitality", vitality(now)).where((F.col("vitality") < PRUNE["vitality"]) & old & (clamp(F.col("confidence")) < PRUNE["confidence"]) & (F.col("tier") != "durable") & ~F.col("pinned"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("vitality", "id"))
    return eligible.withColumn("turn", turn).join(limits, by).where(F.col("turn") <= F.col("most")).select(*by, "id", "vitality", "turn")


def promoted_tier(now: Column) -> Column:
    """ephemeral - working (2 accesses or confidence 0.9, an hour old) - durable (3 accesses, 0.8, a day old)."""
    age, conf, uses = hours_between(F.col("created_at"), now), clamp(F.col("confidence")), F.col("access_count")
    return (
        F.when((F.col("tier") == "ephemeral") & ((uses >= 2) | (conf >= 0.9)) & (age >= 1), "working")
        .when((F.col("tier") == "working") & (uses >= 3) & (conf >= 0.8) & (age >= 24), "durable")
        .otherwise(F.col("tier"))
    )


def access_score(now: Column) -> Column:
    return F.col("access_count") * F.pow(F.lit(0.5), hours_between(F.coalesce("last_accessed_at", "created_at"), now) / ACCESS_HALF_LIFE)


def evidence(memory: Column, answer: Column, resolution: Column, corrected: Column, cross_session: Column) -> Column:
    """0.65 lexical overlap + 0.35 resolution - 0.7 if corrected + 0.05 across sessions, within 0..1."""
    long = lambda t: F.array_distinct(F.filter(tx.tokens(t), lambda x: F.length(x) > 1))
    own = long(memory)
    overlap = F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, long(answer))) / F.size(own))
    weight = F.when(resolution == "explicit_success", 1.0).when(resolution == "implicit_success", 0.8).when(resolution == "rephrased", 0.45).when(resolution == "failure", 0.0).otherwise(0.7)
    return clamp(0.65 * overlap + 0.35 * weight - F.when(corrected, 0.7).otherwise(0.0) + F.when(cross_session, 0.05).otherwise(0.0))


def usefulness(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Beta update of feedback(by.., prior, evidence, corrected, cross_session): the prior's pseudo-counts plus
    the sums of evidence, which are additive and so need no order."""
    e = F.col("evidence")
    good = (e >= 0.7) & ~F.col("corrected")
    sums = feedback.groupBy(*by).agg(
        F.max("prior").alias("prior"), F.sum(e).alias("e"), F.sum(1 - e).alias("f"), F.count("*").alias("retrieved"), F.count_if(e >= 0.35).alias("used"),
        F.count_if(good).alias("successful"), F.count_if(good & F.col("cross_session")).alias("cross_used"), F.count_if("corrected").alias("contradictions"),
    )
    prior = clamp(F.col("prior"), 0.5)
    out = sums.withColumns({"alpha": 1 + 4 * prior + F.col("e"), "beta": 1 + 4 * (1 - prior) + F.col("f")})
    return out.withColumn("usefulness", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("e", "f", "prior")


def quality_snapshot(usefulness_: Column, alpha: Column, beta: Column, authority: Column, contradictions: Column, retrieved: Column) -> Column:
    """0.45 utility + 0.30 stability + 0.20 authority + 0.05 (1 - contradiction risk)."""
    risk = clamp(F.when(retrieved > 0, contradictions / retrieved).when(contradictions > 0, 1.0).otherwise(0.0))
    stability = clamp(F.when(alpha.isNotNull() & beta.isNotNull(), alpha / F.greatest(alpha + beta, F.lit(1.0))).otherwise(usefulness_))
    return clamp(0.45 * clamp(usefulness_, 0.5) + 0.30 * stability + 0.20 * clamp(authority, 0.5) + 0.05 * (1 - risk))


def lineage(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Revision number, what each row supersedes and what superseded it, within its chain."""
    chain = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"revision": F.row_number().over(chain), "supersedes": F.lag("id").over(chain), "superseded_by": F.lead("id").over(chain), "root": F.first("id").over(chain)})


def idle_sessions(turns: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Sessions that end after `gap` of silence: start, close (the last turn seen) and count."""
    sessions = turns.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("opened_at"), F.max("ts").alias("closed_at"))
    return sessions.drop("w")


def bind_to_sessions(evidence_: DataFrame, sessions: DataFrame, by: str, now: Column) -> DataFrame:
    """Each piece of evidence with the narrowest session that contains it, the later start among equals. The
    equality on `by` carries the join; the range is its condition."""
    s = sessions.withColumn("ends", F.coalesce("closed_at", now))
    inside = evidence_.join(s, by).where((F.col("ts") >= F.col("opened_at")) & (F.col("ts") <= F.col("ends")))
    first = Window.partitionBy("evidence_id").orderBy((F.unix_seconds(F.col("ends").cast("timestamp")) - F.unix_seconds(F.col("opened_at").cast("timestamp"))).asc(), F.desc("opened_at"), F.asc("session_id"))
    return inside.withColumn("k", F.row_number().over(first)).where("k = 1").select("evidence_id", by, "session_id")


def missing_handoffs(sessions: DataFrame, work: DataFrame, handoffs: DataFrame, by: str) -> DataFrame:
    """Sessions with captured work and no handoff."""
    return sessions.join(work.select(by).distinct(), by, "left_semi").join(handoffs.select(by).distinct(), by, "left_anti")


def recurring_gaps(items: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Items that come back: fingerprint, count and score min(0.99, 0.1 n)."""
    norm = tx.normalised(F.col("item"))
    found = items.groupBy(*by, F.sha2(norm, 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(norm).alias("item"))
    return found.withColumns({"kind": F.lit(kind), "score": F.least(F.lit(0.99), 0.1 * F.col("n"))})


def newest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("keeps", F.col("k") == 1).drop("k")


def merge(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: changes win, other rows stay. Columns are those of current."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(*current.columns))
