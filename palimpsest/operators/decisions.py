"""Decisions about single writes and hits: what kind a memory is, whether a text may replace another, what an overlay
does, and the keyed updates that follow. Everything is an expression on a row, or one shuffle on the key of the update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

# Cue lists, kinds and defaults.
KINDS = (
    ("session_handoff", r"(?i)\bsession handoff\b|\bresume here\b|\bnext time\b"),
    ("debugging_active", r"(?i)\bdebugging\b|\bfailing test\b|\btest failure\b|\bblocked\b"),
    ("current_status", r"(?i)\bcurrent status\b|\bcurrently\b"),
    ("planning_active", r"(?i)\bplan\b|\bnext step\b|\bmilestone\b"),
    ("architecture_reference", r"(?i)\barchitecture\b|\binvariant\b|\bpipeline\b|\bdata flow\b|\bpostProcessRecallResults\b"),
    ("research_context", r"(?i)\bscout\b|\bresearch\b"),
    ("deploy_ops", r"(?i)\bdeploy(?:ed)?\b|\bpm2\b|\bDigitalOcean\b|\bport 7700\b"),
    ("admin_process", r"(?i)\badmin(?:istrative)?\b|\bworkflow\b|\bbd prime\b|\bpush git changes\b"),
    ("operational_noise", r"(?i)\bbuilder brief\b|\btask initialization\b|\bhousekeeping\b|\bmaintenance\b|\btsconfig\.json\b|\bnpx\s+tsx\b|\bscript runs?\b"),
)
CURRENTNESS = (
    r"\breplac(?:e|es|ed|ing)\b",
    r"\bno longer\b",
    r"\binstead of\b",
    r"\bmigrat(?:e|es|ed|ing)\b",
    r"\bswitch(?:ed|ing)?\s+(?:\w+ly\s+)?(?:to|from|off|over|away)\b",
    r"\bmoved?\s+(?:\w+ly\s+)?(?:to|off|from|over|away)\b",
    r"\bmoved?\s+on\s+to\b",
    r"\btransition(?:ed|ing|s)?\s+(?:\w+ly\s+)?(?:to|from|away)\b",
    r"\b(?:dropped|ditched)\s+(?!the\b|a\b|an\b)(?:\w+\s+){0,3}(?:for\b|in favor of\b)",
    r"\bis now\b",
    r"\bas of\b",
    r"\btook over\b",
    r"\btaking over\b",
    r"\bstepped down\b",
    r"\bthe new\b",
    r"\b(?:updated|changed|upgraded)\s+(?:to|from)\b",
)
TRANSIENCE = (
    r"\bfor now\b",
    r"\bfor the moment\b",
    r"\bfor the time being\b",
    r"\btemporarily\b",
    r"\bat the moment\b",
    r"\bright now\b",
    r"\bthis (?:week|month|morning|afternoon|evening|sprint)\b",
    r"\btoday\b",
    r"\btonight\b",
)
IDENTITY = (
    ("profile:name", "profile", r"(?i)\b(name is|called|goes by|known as|my name)\b"),
    ("preferences:addressing", "preferences", r"(?i)\b(address me|call me|refer to me|don't call me)\b"),
    ("profile:role", "profile", r"(?i)\b(i am a|i'm a|i work as|my role|my job)\b"),
    ("preferences:language", "preferences", r"(?i)\b(i prefer|i use|my preferred language|i code in)\b"),
)
FACT_CATEGORIES = ("profile", "preferences", "entities", "events", "cases", "patterns")
FACT_CONFIDENCE = 0.7
MERGED_MEMBERS = 200


def memory_kind(text: Column, role: Column) -> Column:
    """The stored role, but for project_state; else the first kind whose cues the text has; else recent work."""
    kind = F.lit("recent_work")
    for name, cues in reversed(KINDS):
        kind = F.when(text.rlike(cues), name).otherwise(kind)
    return F.when(role.isNotNull() & (role != "project_state"), role).otherwise(kind)


def currentness_cue(text: Column) -> Column:
    """The text says that something has changed."""
    return tx.let(F.lower(text), lambda low: tx.any_match(low, CURRENTNESS))


def durability_reason(stored_tier: Column, new_tier: Column, text: Column) -> Column:
    """Why a passing statement must not replace a durable one; null where it may. An unknown tier alone is no reason."""
    passing = tx.let(F.lower(text), lambda low: tx.any_match(low, TRANSIENCE))
    guarded = (stored_tier == "durable") & ~new_tier.eqNullSafe(F.lit("durable"))
    return F.when(guarded & (new_tier == "ephemeral"), "ephemeral-over-durable").when(guarded & passing, "transient-over-durable")


def ordering_reason(stored_at: Column, new_at: Column, now: Column) -> Column:
    """Why a statement must not replace a newer one, from times as strings; null where it may. A missing new time is
    `now`, one that can't be read keeps both."""
    absent = new_at.isNull() | (new_at == "")
    new = F.when(absent, now).otherwise(new_at.try_cast("timestamp"))
    stored = stored_at.try_cast("timestamp")
    return F.when(new.isNull(), "invalid-incoming-validAt").when(stored.isNull(), "invalid-candidate-time").when(new < stored, "older-incoming")


def overlay_outcome(fact_key: Column, subject_key: Column, stored: Column, text: Column) -> Column:
    """What a write does to the overlay's record under the same two keys: nothing if the texts are equal, a merge if
    one holds the other, else it supersedes. Without both keys, or without a record, it is new."""
    engaged = (F.trim(fact_key) != "") & (F.trim(subject_key) != "") & stored.isNotNull()
    old, new = tx.normalised(stored), tx.normalised(text)
    decided = F.when(old == new, "skip").when(F.contains(old, new) | F.contains(new, old), "merge-update").otherwise("supersede")
    return F.when(F.coalesce(engaged, F.lit(False)), decided).otherwise("create")


def overlay_merge(durable: DataFrame, overlay: DataFrame, records: DataFrame) -> DataFrame:
    """durable(id, active, score, text), overlay(id, text), records(id, active): the durable hits with the overlay's
    text in place of theirs, and the overlay's entries beside them. An entry whose durable hit, or else whose record, is
    inactive or missing is left out. Entries replace hits one for one; a null flag of a hit is looked up as if the hit
    weren't there."""
    hits = durable.select("id", F.col("active").alias("hit_active"), "score", F.col("text").alias("hit_text"), F.lit(True).alias("found"))
    known = records.select("id", F.col("active").alias("record_active")).join(overlay.select("id"), "id", "left_semi")
    entries = overlay.select("id", F.col("text").alias("new_text"), F.lit(True).alias("entered")).join(known, "id", "left")
    joined = hits.join(entries, "id", "full_outer")
    wins = F.col("entered") & F.coalesce("hit_active", "record_active", F.lit(False))
    wins = F.coalesce(wins, F.lit(False))
    kept = joined.where(F.col("found") | wins)
    return kept.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(wins, F.col("new_text")).otherwise(F.col("hit_text")).alias("text"), wins.alias("from_overlay"))


def reranked(hits: DataFrame, least: float, floor: float | None = None) -> DataFrame:
    """hits(score, rerank, preserve): those whose rerank score reaches `least`, or that are preserved. The rerank score
    replaces the score; one that is preserved only rises to `floor` where that is given."""
    passed = F.coalesce(F.col("rerank") >= least, F.lit(False))
    score = F.coalesce("rerank", "score")
    if floor is not None:
        score = F.when(passed, F.col("rerank")).otherwise(F.greatest(F.coalesce("rerank", F.lit(0.0)), F.lit(floor)))
    return hits.where(passed | F.coalesce("preserve", F.lit(False))).withColumn("score", score)


def merged_entries(members: DataFrame) -> DataFrame:
    """members(cluster, id, text, confidence, category): one entry for each cluster. Its lines are the members' trimmed
    lines in order of id and place, the first of those equal in lower case; its confidence is the highest, its category
    the most frequent one, the first by id of several. A cluster has MERGED_MEMBERS members at most, by its scan."""
    lines = members.select("cluster", "id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    first = lines.groupBy("cluster", F.lower("line").alias("key")).agg(F.min(F.struct("id", "at", "line")).alias("line"))
    texts = first.groupBy("cluster").agg(F.array_sort(F.collect_list("line")).alias("lines")).select("cluster", F.array_join(F.col("lines.line"), "\n").alias("text"))
    votes = members.groupBy("cluster", "category").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("confidence").alias("confidence"))
    heads = votes.groupBy("cluster").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("members"), F.max_by("category", F.struct("n", -F.col("first"))).alias("category"))
    return heads.join(texts, "cluster", "left")


def boundary_hash(*fields: Column) -> Column:
    """sha256 over strings in order: a zero byte for one that is absent, else a one byte and its JSON form."""
    part = lambda f: F.when(f.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(F.to_json(F.array(f)).substr(F.lit(2), F.length(F.to_json(F.array(f))) - 2), "UTF-8")))
    return F.sha2(F.concat(*map(part, fields)), 256)


def cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Dollars for tokens at prices a million; null without any token."""
    used_in, used_out = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    return F.when((used_in > 0) | (used_out > 0), used_in / 1e6 * price_in + used_out / 1e6 * price_out)


def billed_or_estimated(billed: Column, estimated: Column) -> Column:
    """What was billed where it is a cost, else what was estimated, else nothing."""
    valid = lambda c: F.when((c >= 0) & ~F.isnan(c) & (c != F.lit(float("inf"))), c)
    return F.coalesce(valid(billed), valid(estimated), F.lit(0.0))


def normalised_facts(raw: DataFrame) -> DataFrame:
    """raw(id, l2, l0, l1, category, confidence) with the defaults of an extracted fact and its identity key; the
    confidence may be any string, and one that is no number is the floor."""
    l0 = F.coalesce("l0", F.substring("l2", 1, 100))
    number = F.col("confidence").try_cast("double")
    sure = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), FACT_CONFIDENCE).otherwise(number)
    category = F.when(F.col("category").isin(*FACT_CATEGORIES), F.col("category")).otherwise("cases")
    facts = raw.withColumns({"l0": l0, "l1": F.coalesce("l1", F.concat(F.lit("- "), l0)), "category": category, "confidence": sure})
    key = F.lit(None).cast("string")
    for name, of, cues in reversed(IDENTITY):
        key = F.when((F.col("category") == of) & F.col("l2").rlike(cues), name).otherwise(key)
    return facts.withColumn("identity_key", key)


def atomic_action(stored: tuple[Column, Column, Column], new: tuple[Column, Column, Column]) -> Column:
    """retain - both are whole (subject, predicate, value) triples, the first two equal when normalised and without a
    bar, the value equal but for white space at its ends; else clear."""
    whole = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    safe = lambda c: ~F.contains(c, F.lit("|"))
    same = (tx.normalised(stored[0]) == tx.normalised(new[0])) & (tx.normalised(stored[1]) == tx.normalised(new[1])) & (F.trim(stored[2]) == F.trim(new[2]))
    complete = whole(stored[0]) & whole(stored[1]) & whole(stored[2]) & whole(new[0]) & whole(new[1]) & whole(new[2])
    return F.when(complete & safe(new[0]) & safe(new[1]) & same, "retain").otherwise("clear")


def stamped(gaps: DataFrame, changes: DataFrame) -> DataFrame:
    """gaps(gap, status, reported_at) after changes(gap, new_status, new_reported), one a gap; nulls change nothing."""
    return gaps.join(changes, "gap", "left").withColumns({"status": F.coalesce("new_status", "status"), "reported_at": F.coalesce("new_reported", "reported_at")}).drop("new_status", "new_reported")


def mentioned_in(turns: DataFrame, mentions: list[str], k: int = 3) -> DataFrame:
    """The first k turns, by session and turn, whose text holds each mention of a stated list: one scan."""
    low = F.lower(F.col("text"))
    found = F.filter(F.array(*[F.lit(m.lower()) for m in mentions]), lambda m: F.contains(low, m))
    first = Window.partitionBy("mention").orderBy("session", "turn", "role", "text")
    hits = turns.select("session", "turn", "role", "text", F.explode(found).alias("mention"))
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("mention", "rank", "session", "turn")


def tie_safe_watermark(rows: DataFrame, by: list[str], at: str = "at", swept: str = "swept") -> DataFrame:
    """The last time through which every row is swept: strictly below the first that isn't, so that rows of one time are
    never split; null where even the first time is open."""
    open_from = rows.where(~F.col(swept)).groupBy(*by).agg(F.min(at).alias("open_from"))
    times = rows.groupBy(*by, at).agg(F.lit(1).alias("one")).join(open_from, by, "left")
    reached = F.when(F.col("open_from").isNull() | (F.col(at) < F.col("open_from")), F.col(at))
    return times.groupBy(*by).agg(F.max(reached).alias("watermark"))


def remapped(edges: DataFrame, promoted: DataFrame) -> DataFrame:
    """edges(src, dst, confidence) with each src that promoted(old, new) names replaced; edges that become the same are
    one, with the highest confidence."""
    joined = edges.join(promoted.withColumnRenamed("old", "src"), "src", "left").withColumn("src", F.coalesce("new", "src"))
    return joined.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def compare_and_set(states: DataFrame, writes: DataFrame) -> DataFrame:
    """states(key, version, value) after writes(key, expected, new_value): a write takes effect where it expects the
    version there is, or none where there is none; of several the first by value. `applied` says which keys changed."""
    first = writes.groupBy("key", "expected").agg(F.min("new_value").alias("new_value"))
    old = states.select("key", "version", "value")
    fits = old.join(first, "key", "full_outer")
    applied = F.col("new_value").isNotNull() & F.col("version").eqNullSafe(F.col("expected"))
    marked = fits.withColumn("applied", applied)
    best = marked.groupBy("key", "version", "value").agg(F.max("applied").alias("applied"), F.min(F.when(F.col("applied"), F.col("new_value"))).alias("new_value"))
    after = best.where("version is not null or applied")
    return after.select("key", F.when(F.col("applied"), F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(F.col("applied"), F.col("new_value")).otherwise(F.col("value")).alias("value"), "applied")


def write_scope(asked: Column, long_term: Column, session: Column) -> dict[str, Column]:
    """The scope a write goes to, and the session it keeps: what is asked for, an unknown name being user; else session
    where it is said not to be long-term; else user. Only the session scope keeps a session."""
    named = F.nullif(F.trim(asked), F.lit(""))
    known = F.when(named.isin("session", "team", "global"), named).otherwise("user")
    scope = F.when(named.isNotNull(), known).when(~long_term, "session").otherwise("user")
    return {"scope": scope, "session_id": F.when(scope == "session", session)}
