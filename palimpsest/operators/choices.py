"""Choices among a bounded few (a batch, a scan of one user, the hits of a query) and the signals of a correction.

A greedy choice depends on its own order: the pairs of one group, few by the group's bound, are folded in order
inside an expression; groups are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vec
from palimpsest.operators import arbitration as ar
from palimpsest.operators import decisions as dc
from palimpsest.operators.stored import written

# Marker tags, tag prefixes, thresholds, categories with their cues in order, statuses.
MARKERS = ("update", "supersedes_prior", "invalidation", "no_longer_true")
NO_SLOT = ("speaker:", "status:")
SUBJECT = r"^(?:project|subject|person|owner|entity|service|app|repo):(.+)$"
BATCH_SIMILARITY, COMPACT_SIMILARITY, COMPACT_DAYS, COMPACT_SCAN = 0.85, 0.88, 7, 200
HOPS = 50
PACKET_TOKENS = 600
PREFERENCE = r"(?i)\b(prefer|preference|preferred|likes?|dislikes?|usually|always|never|must|do not|don't|avoid|style|convention|setting|configuration)\b"
PACKET = (
    ("hard_constraints_safety_privacy", r"(?i)\b(secret|credential|api key|token|privacy|private|permission|approval|destructive|production|must|never|do not|don't|avoid)\b"),
    ("tools_environment", r"(?i)\b(vitest|typescript|eslint|npm|pnpm|yarn|gitnexus|beads|bd |claude|codex|opencode|surreal|sqlite|postgres|tool|cli|terminal|config|setting)\b"),
    ("coding_style", r"(?i)\b(style|format|lint|strict|naming|typescript|refactor|test|coverage|comment|ascii)\b"),
    ("workflow_process", r"(?i)\b(plan|bead|handoff|review|verify|test harness|proof|phase|workflow|process|gate|commit|push)\b"),
    ("communication_style", r"(?i)\b(tone|concise|verbose|explain|wording|call me|address|speak|summary)\b"),
    ("ui_product_taste", r"(?i)\b(ui|ux|frontend|design|color|palette|card|button|layout|dashboard|product)\b"),
    ("business_preferences", r""),
)
CLAIM_VERSIONS = ("claim-v1", "revision-v1", "record-v1")
STATUSES = ("active", "superseded", "conflicted", "rejected")
TRANSITIONS = (("active", "superseded"), ("active", "conflicted"), ("active", "rejected"), ("conflicted", "active"), ("conflicted", "superseded"), ("conflicted", "rejected"))


def plain_tags(tags: Column) -> Column:
    """Trimmed tags in lower case, without empty ones; none for null."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def correction_marker(tags: Column) -> Column:
    return F.arrays_overlap(plain_tags(tags), F.array(*[F.lit(m) for m in MARKERS]))


def slots(tags: Column) -> Column:
    """The tags that name an attribute, underscores as hyphens."""
    named = F.filter(plain_tags(tags), lambda t: t.contains(":") & ~t.startswith(NO_SLOT[0]) & ~t.startswith(NO_SLOT[1]))
    return F.array_distinct(F.transform(named, lambda t: F.replace(t, F.lit("_"), F.lit("-"))))


def subjects(tags: Column) -> Column:
    """The values of the tags that name a subject, whatever their prefix."""
    value = lambda t: F.regexp_extract(F.replace(t, F.lit("_"), F.lit("-")), SUBJECT, 1)
    return F.array_distinct(F.filter(F.transform(plain_tags(tags), value), lambda v: v != ""))


def same_slot(old: Column, new: Column) -> Column:
    """Two slot tags or more in common."""
    return F.size(F.array_intersect(slots(old), slots(new))) >= 2


def conflicting_subjects(old: Column, new: Column) -> Column:
    """Both name subjects, and none in common."""
    a, b = subjects(old), subjects(new)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def changed_subjects(old: Column, new: Column) -> Column:
    """Both name a subject in common, and one names another besides."""
    a, b = subjects(old), subjects(new)
    return F.arrays_overlap(a, b) & (F.size(F.array_union(a, b)) > F.size(F.array_intersect(a, b)))


def keep_both_reason(old: Column, new: Column, old_tags: Column, tags: Column) -> Column:
    """Why two close statements both stay; null where they may merge."""
    was, now = ar.occasion(old), ar.occasion(new)
    kind = lambda o: F.when(o.startswith("Q"), 2).when(F.length(o) == 10, 1).otherwise(3)
    elsewhere = (was != now) & (kind(was) == kind(now)) & F.arrays_overlap(subjects(old_tags), subjects(tags))
    return (
        F.when(conflicting_subjects(old_tags, tags) & ar.additive(old, new), "conflicting-subjects")
        .when(elsewhere, "distinct-occasion")
        .when(same_slot(old_tags, tags) & changed_subjects(old_tags, tags) & ~dc.currentness_cue(new), "ambiguous-slot-change-no-cue")
    )


def proof(old_anchors: dict[str, Column], new_anchors: dict[str, Column], keys: dict[str, tuple[Column, Column]]) -> Column:
    """Whether two statements are about one thing, by sets of anchors of each kind and by keys(name: old, new) in
    order: kinds that both name, differently, are a conflict; an equal key that isn't blank proves; an equal kind does last."""
    both = {k: (F.size(a) > 0) & (F.size(new_anchors[k]) > 0) for k, a in old_anchors.items()}
    same = {k: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(new_anchors[k])) for k, a in old_anchors.items()}
    verdict = F.when(F.exists(F.array(*[both[k] & ~same[k] for k in both]), lambda x: x), "anchor-conflict")
    for name, (a, b) in keys.items():
        verdict = verdict.when((F.trim(a) != "") & (F.trim(a) == F.trim(b)), f"key:{name}")
    return verdict.when(F.exists(F.array(*[both[k] & same[k] for k in both]), lambda x: x), "anchor-shared").otherwise("unproven")


def attribute(body: Column, fallback: Column) -> Column:
    """The body's value, or else the fallback: trimmed, blank as absent."""
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))


def greedy_losers(pairs: DataFrame, by: list[str], *order: str) -> DataFrame:
    """pairs(by.., a, b, loser) of each group in `order`: a pair of which either has lost is passed over, of
    another the loser loses to the other one. (by.., id, winner). Groups must be bounded by their scan."""
    lost_type = "array<struct<id:bigint,winner:bigint>>"
    folded = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"at{k}") for k, c in enumerate(order)], "a", "b", "loser"))).alias("pairs"))

    def step(lost: Column, p: Column) -> Column:
        winner = F.when(p["loser"] == p["a"], p["b"]).otherwise(p["a"])
        settled = F.exists(lost, lambda x: (x["id"] == p["a"]) | (x["id"] == p["b"]))
        return F.when(settled, lost).otherwise(F.concat(lost, F.array(F.struct(p["loser"].cast("long").alias("id"), winner.cast("long").alias("winner"))))).cast(lost_type)

    lost = F.aggregate("pairs", F.array().cast(lost_type), step)
    return folded.select(*by, F.inline(lost))


def batch_losers(facts: DataFrame, by: list[str], least: float = BATCH_SIMILARITY) -> DataFrame:
    """facts(by.., id, confidence, embedding) of one batch of an extraction: of two that are closer than `least` the
    less confident goes, the later one of equals, in the order of ids. A null confidence is 0."""
    rows = facts.where("embedding is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    a = rows.select(*by, F.col("id").alias("a"), F.col("confidence").alias("ca"), F.col("embedding").alias("va"))
    b = rows.select(*by, F.col("id").alias("b"), F.col("confidence").alias("cb"), F.col("embedding").alias("vb"))
    near = a.join(b, by).where("a < b").where(vec.cosine(F.col("va"), F.col("vb")) > least)
    return greedy_losers(near.select(*by, "a", "b", F.expr("if(ca >= cb, b, a)").alias("loser")), by, "a", "b")


def compacted(records: DataFrame, now: Column, least: float = COMPACT_SIMILARITY, scan: int = COMPACT_SCAN) -> DataFrame:
    """records(user_id, id, active, created_at, confidence, embedding): of each user's `scan` oldest active ones
    that are a week old, the most confident first gathers all that are close to it and not gathered yet.
    (user_id, id, winner): the members of clusters of two or more, but for their seed."""
    old = records.where("coalesce(active, true) and embedding is not null").where(F.col("created_at") < now - F.make_dt_interval(days=F.lit(COMPACT_DAYS)))
    place = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    rows = old.withColumn("k", place("created_at", "id")).where(F.col("k") <= scan).withColumn("k", place(F.coalesce("confidence", F.lit(0.5)).desc(), "id"))
    a = rows.select("user_id", F.col("id").alias("a"), F.col("k").alias("ka"), F.col("embedding").alias("va"))
    b = rows.select("user_id", F.col("id").alias("b"), F.col("k").alias("kb"), F.col("embedding").alias("vb"))
    near = a.join(b, "user_id").where("ka < kb").where(vec.cosine(F.col("va"), F.col("vb")) >= least)
    return greedy_losers(near.select("user_id", "ka", "kb", "a", "b", F.col("b").alias("loser")), ["user_id"], "ka", "kb")


def would_cycle(proposed: DataFrame, pointers: DataFrame, hops: int = HOPS) -> DataFrame:
    """proposed(user_id, id, target) with `cycle`: from the target along pointers(user_id, id, next) of the user, the
    walk comes to the id, or is `hops` records long and more, as one that never ends is. Walks double in length,
    so that six joins do; each is written, since the next one reads it twice."""
    walk = pointers.where("next is not null").select("user_id", "id", F.array("next").alias("tail"))
    length = 1
    while length < hops:
        further = walk.select("user_id", F.col("id").alias("last"), F.col("tail").alias("more"))
        ends = walk.withColumn("last", F.element_at("tail", -1))
        joined = ends.join(further, ["user_id", "last"], "left")
        walk = written(joined.select("user_id", "id", F.concat("tail", F.coalesce("more", F.array().cast("array<bigint>"))).alias("tail")))
        length *= 2
    found = proposed.join(walk.withColumnRenamed("id", "target"), ["user_id", "target"], "left")
    chain = F.slice(F.concat(F.array("target"), F.coalesce("tail", F.array().cast("array<bigint>"))), 1, hops)
    cycle = (F.size(chain) >= hops) | F.array_contains(chain, F.col("id"))
    return found.where("target is not null").select("user_id", "id", "target", cycle.alias("cycle"))


def packet_category(text: Column) -> Column:
    """Place of the first category whose cues the text has."""
    return F.coalesce(*[F.when(text.rlike(cues), k) for k, (_, cues) in enumerate(PACKET[:-1])], F.lit(len(PACKET) - 1))


def preference_packet(hits: DataFrame, by: list[str], budget: int = PACKET_TOKENS) -> DataFrame:
    """hits(by.., id, text, score, category, place) of each query, few: those that state a preference, by packet
    category, score and place, as long as they fit; one that doesn't is passed over and the next is tried.
    (by.., used, ids, left_out); queries without any that fits have no packet."""
    text = F.regexp_replace(F.replace("text", F.lit("\0"), F.lit("")), r"\x1b\[[0-9;]*m", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"^>{1,2}[ \t\n\f\r]*", ""), r"[ \t\n\f\r]+", " "))
    liked = hits.where(F.col("category").isin("preferences", "profile") | F.coalesce(F.col("text").rlike(PREFERENCE), F.lit(False)))
    items = liked.withColumn("clean", text).where("clean <> ''")
    item = F.struct(packet_category(F.col("clean")).alias("at"), (-F.col("score")).alias("lower"), "place", "id", tx.token_estimate(F.col("clean")).cast("long").alias("tokens"))
    state = "struct<used:bigint,ids:array<bigint>,left_out:bigint>"

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["tokens"] <= budget
        taken = F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["ids"], F.array(x["id"].cast("long"))).alias("ids"), s["left_out"].alias("left_out"))
        return F.when(fits, taken).otherwise(F.struct(s["used"].alias("used"), s["ids"].alias("ids"), (s["left_out"] + 1).alias("left_out"))).cast(state)

    start = F.struct(F.lit(0).alias("used"), F.array().alias("ids"), F.lit(0).alias("left_out")).cast(state)
    packed = items.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return packed.select(*by, F.aggregate("items", start, step).alias("p")).select(*by, "p.*").where(F.size("ids") > 0)


def identity_part(value: Column, *fallbacks: Column) -> Column:
    """Lower case, white space as single spaces; the first of the fallbacks, as normalised, for a blank one."""
    return F.coalesce(*[F.nullif(tx.normalised(c), F.lit("")) for c in (value, *fallbacks)])


def hashed(*parts: Column) -> Column:
    """sha256 over strings with a zero byte between; null as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\0"), 256)


def claim_contract(user: Column, scope: Column, path: Column, fact_key: Column, subject: Column, predicate: Column, value: Column, versions: tuple[str, str, str] = CLAIM_VERSIONS) -> dict[str, Column]:
    """The claim's key, by what it is about, its revision, by what it says, and its record's id. subject and predicate
    as identity_part gives them; versions are the hashes' prefixes, which a store that has claims already must keep."""
    claim, revision, record = versions
    said = F.trim(F.regexp_replace(value, r"[ \t\r\n\f]+", " "))
    key = hashed(F.lit(claim), user, F.coalesce(scope, F.lit("user")), F.coalesce(path, F.lit("*")), F.nullif(F.trim(fact_key), F.lit("")), subject, predicate)
    key = F.substring(key, 1, 32)
    return {"claim_key": key, "revision": hashed(F.lit(revision), key, said), "record_id": F.substring(F.sha2(F.concat(F.lit(f"{record}::"), key), 256), 1, 24)}


def claim_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("active")


def allowed_transition(old: Column, new: Column) -> Column:
    """A claim may stay as it is; active and conflicted ones may change, superseded and rejected ones never."""
    return (old == new) | F.concat_ws(">", old, new).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
