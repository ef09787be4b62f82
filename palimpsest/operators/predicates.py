"""Filters as Columns, to be pushed into the scan: tenancy, scope, validity, attributes and text gates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

# Text gates, tried in the order given.
FORCE_RETRIEVE = (
    r"(?i)\b(remember|recall|forgot|forget)\b",
    r"(?i)\b(yesterday|last\s*week|last\s*month|last\s*time|earlier\s*today|previously)\b",
    r"(?i)\b(my\s*(name|email|api\s*key|config|settings?|preferences?|password|address))\b",
    r"(?i)\bwhat\s+(did|do)\s+(i|we)\b",
    r"(?i)\bwhat\s+do\s+you\s+know\s+about\b",
    r"(?i)\bsave\s+this\b",
)
SKIP_RETRIEVE = (
    r"(?i)^(hi|hello|hey|howdy|yo|sup|hiya|good\s*(morning|afternoon|evening|night))[\s!.,?]*$",
    r"^/",
    r"(?i)^(ls|cd|pwd|cat|echo|mkdir|rm|cp|mv|grep|find|git|npm|npx|yarn|pnpm|bun|docker|kubectl)\b",
    r"(?i)^(ok|okay|sure|yes|yeah|yep|yup|no|nah|nope|thanks|thank\s*you|thx|ty|got\s*it|understood|alright|sounds?\s*good|will\s*do|perfect|noted|right|correct|exactly|agreed|fine|cool|great|nice|good|awesome)[\s!.,?]*$",
    r"(?i)^HEARTBEAT$",
    r"(?i)^\[System\]",
    r"(?i)^ping[\s!.,?]*$",
    r"^[\s\p{P}]*$",
    r"(?i)^(lol|lmao|haha|heh|hmm|ah|oh|ugh|mhm|uh-huh)[\s!.,?]*$",
)
# The blocks that hold emoji; the regular expressions of older Java versions have no property for them.
EMOJI_ONLY = r"^[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FA}\x{25AA}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\s]+$"
NOISE_FACTS = (
    r"(?i)\b(i don'?t have|i cannot|i can'?t|i am not able to|i'?m unable to|i do not have|i lack)\b.*\b(information|access|knowledge|data|details)\b",
    r"(?i)\b(as an ai|as a language model|i'?m just an ai)\b",
    r"(?i)\b(do you remember|can you recall|did you save|what did (i|we) say|what do you know about)\b",
    r"(?i)^(ok|okay|got it|understood|sure|great|thanks|thank you|alright|sounds good|will do|perfect|noted)[.!]?$",
    r"(?i)\[tool (call|result|error)\]",
    r"(?i)^(true|false|null|undefined|NaN)$",
)
EXACT_QUERY = (
    r"(?i)\bexact(?:ly)?\b",
    r"(?i)\bverbatim\b",
    r"(?i)\bwhich\b",
    r"(?i)\bwhen\b",
    r"(?i)\bwhat\b",
    r"(?i)\bwho\b",
    r"(?i)\bhow many\b",
    r"(?i)\blist\b",
    r"(?i)\bversion\b",
    r"(?i)\bport\b",
    r"(?i)\bcommit\b",
    r"(?i)\bdate\b",
    r"(?i)\bvalue\b",
    r"(?i)\banswer\b",
)
EXACT_VALUE = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d+(?:\.\d+){1,}\b",
    r"\b\d+\b",
    r"\b[A-Z][A-Za-z0-9_-]*-\d+\b",
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"`[^`]+`",
    r"/[\w./-]+",
    r"(?i)\b[\w.-]+\.(?:ts|tsx|js|jsx|json|md|py|rs|go|sql|yaml|yml)\b",
    r"(?i)\b[a-f0-9]{7,40}\b",
    r"\b[A-Z0-9_]+=[^\s]+",
    r"(?i)https?://\S+",
    r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S",
)
CATEGORY_FLOORS = {"profile": 0.7, "preferences": 0.7, "entities": 0.85, "events": 0.85, "cases": 0.8, "patterns": 0.8}
HANDOFF_CUES = (
    "session handoff", "resume here", "next time",
    "resume point", "resume points", "resume order", "next resume point", "next designated resume point",
    "handoff doc created", "handoff document created", "handoff was created", "handoff document was created", "handoff doc was created",
    "durable handoff doc is already committed", "handoff committed to docs/handoffs/", "handoff doc committed to docs/handoffs/",
)



def is_active() -> Column:
    """Null means active."""
    return F.coalesce("active", F.lit(True))


def is_valid(now: Column) -> Column:
    return F.col("invalid_at").isNull() | (F.col("invalid_at") > now)


def every(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def in_scope(scope: str, session_id: str | None = None, team_id: str | None = None) -> Column:
    """all; session, team (nothing without an id); user (and rows without a scope); default: user rows and the current session's."""
    user = (F.col("scope") == "user") | F.col("scope").isNull()
    if scope == "all":
        return F.lit(True)
    if scope == "session":
        return (F.col("scope") == "session") & (F.col("session_id") == session_id) if session_id else F.lit(False)
    if scope == "team":
        return (F.col("scope") == "team") & (F.col("team_id") == team_id) if team_id else F.lit(False)
    if scope == "user":
        return user
    return user | ((F.col("scope") == "session") & (F.col("session_id") == session_id)) if session_id else user


def on_path(path: str | None) -> Column:
    """Rows of the path and rows without one."""
    return (F.col("path") == path) | F.col("path").isNull() if path else F.lit(True)


def soft(since: str | None = None, tier: str | None = None, least_confidence: float | None = None, categories: list[str] | None = None) -> Column:
    """Optional filters; an unreadable `since` is ignored, a null confidence fails a floor."""
    parts = []
    if since is not None:
        at = F.try_to_timestamp(F.lit(since))
        parts.append(at.isNull() | (F.col("created_at") >= at))
    if tier is not None:
        parts.append(F.col("tier") == tier)
    if least_confidence is not None:
        parts.append(F.coalesce("confidence", F.lit(-1.0)) >= least_confidence)
    if categories:
        parts.append(F.col("category").isin(categories))
    return every(parts)


def normalised_query(text: Column) -> Column:
    """A query without its scheduler wrapper and time stamp."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^Cron\s+job\s*\([^)]*\):\s*", ""), r"^\[\d{4}-\d{2}-\d{2}T[^\]]*\]\s*", ""))


def skips_retrieval(text: Column, least: int = 5) -> Column:
    """Forced retrieval first, then short texts, then small talk and commands, then a length floor (6 with CJK, else 15)."""
    query = normalised_query(text)
    cjk = query.rlike("[一-鿿぀-ヿ가-힯]")
    return (
        F.when(tx.any_match(query, FORCE_RETRIEVE), False)
        .when(F.length(query) < least, True)
        .when(tx.any_match(query, SKIP_RETRIEVE) | query.rlike(EMOJI_ONLY), True)
        .otherwise(F.length(query) < F.when(cjk, 6).otherwise(15))
    )


def is_noise(text: Column) -> Column:
    return (F.length(F.trim(text)) < 10) | tx.any_match(F.trim(text), NOISE_FACTS)


def confidence_floor(floor: float = 0.7, unknown: float = 0.95) -> Column:
    """The category's floor, unknown categories' floor, never below the global one, which null categories get."""
    by = F.when(F.col("category").isNull(), floor).otherwise(unknown)
    for name, least in CATEGORY_FLOORS.items():
        by = F.when(F.col("category") == name, least).otherwise(by)
    return F.greatest(F.lit(floor), by)


def exact_value_signal(text: Column) -> Column:
    return tx.any_match(text, EXACT_VALUE)


def exact_intent(query: Column) -> Column:
    q = F.trim(query)
    asks = tx.any_match(q, EXACT_QUERY)
    return (q != "") & (F.contains(q, F.lit("?")) | asks) & (exact_value_signal(q) | asks)


def has_handoff_cue(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(cue)) for cue in HANDOFF_CUES])


def relevance_gate(hits: DataFrame, by: list[str], floor: float) -> DataFrame:
    """All of a query's hits go if its best score is below the floor."""
    best = hits.groupBy(*by).agg(F.max("score").alias("best")).where(F.col("best") >= floor)
    return hits.join(best.drop("best"), by, "left_semi")


def noise_like(rows: DataFrame, prototypes: DataFrame, threshold: float = 0.92) -> DataFrame:
    """rows with `noise`: whether the best cosine with a prototype is above the threshold. The prototype
    bank is bounded (about 200 vectors) and joined into each row as one array: no pair is shuffled."""
    bank = prototypes.agg(F.collect_list("embedding").alias("bank"))
    from palimpsest.functions.vectors import cosine

    joined = rows.join(F.broadcast(bank), F.lit(True))
    best = F.array_max(F.transform("bank", lambda p: cosine(F.col("embedding"), p)))
    return joined.withColumn("best", best).withColumn("noise", F.coalesce(F.col("best") > threshold, F.lit(False))).drop("bank")
