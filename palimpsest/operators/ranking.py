"""Re-ranking and selection stages over scored hits. A stage maps a DataFrame with `score` to another one;
`run_plan` applies a list of them in order. Groups are one query's hits, bounded by its limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

# Ranking constants and cue lists.
INTENTS = (
    ("session_opener", r"(?i)^(hi|hello|hey|good morning|good afternoon|good evening|what's up|let'?s (continue|resume|pick up)|where (were|did) we leave off|catch me up|status update|resume|continue|(?:just\s+)?starting a new session)\b"),
    ("architecture", r"(?i)\b(how should we|what sections should|what belongs in|what regression checks?|what navigation|what should .* keep versus skip|how do we keep .* while still reusing|how do we prove .* are present but demoted|what exactly do we need to inspect|how do we evolve .* instead of|what ranking or selection metadata should|how should we expose raw json|what navigation affordances should|how do we tell reviewers)\b"),
    ("architecture", r"(?i)\b(html review surface|artifact contract|turn-by-turn replay|seed(?:ed)? history|recency buckets?|raw artifacts?|track navigation|turn navigation|retrieval trace id|selected ids|db delta|interesting turns?)\b"),
    ("workflow_posture", r"(?i)\b(highest-priority|top priority|what should the assertions prove|do we have any blocker|what(?:'s| is) the next step|let'?s write the handoff|write the handoff|priority outcome|surface blockers?)\b"),
    ("latest_state", r"(?i)\b(latest state|current state|current truth|latest truth|most recent state|active representative)\b"),
    ("latest_state", r"(?i)\b(what is|what's|show me|tell me)\s+the\s+(latest|current|active)\b"),
    ("exact_lookup", r"(?i)\b(exact lookup|exact match|direct lookup|look up exactly)\b"),
    ("decision_trace", r"(?i)\b(decision trace|decision history|why did we decide|why was .* chosen|tradeoff history)\b"),
    ("exploratory_topic", r"(?i)\b(explore|exploratory|broad overview|survey|landscape|tell me everything about)\b"),
    ("unknown_mixed", r"(?i)\b(mixed bag|not sure|ambiguous|unknown mixed)\b"),
    ("preference", r"(?i)\b(prefer|preference|preferences|preferred|favorite|favourite|like to|style|habit|convention|setting|configuration)\b"),
    ("preference", r"(?i)\b(how do i|what do i|my preferred|i usually|i always|i tend to)\b"),
    ("preference", "偏好|喜欢|习惯|风格"),
    ("decision", r"(?i)\b(decide|decided|decision|chose|chosen|why did we|rationale|tradeoff|trade-off|approach)\b"),
    ("decision", r"(?i)\b(opted for|went with|picked|selected|agreed on)\b"),
    ("decision", "决定|选择|权衡"),
    ("current_status", r"(?i)\b(what are we working on|current status|status update|where are we|what changed in the current status)\b"),
    ("recent_work", r"(?i)\bMIM-\d+\b"),
    ("recent_work", r"(?i)\b(recent work|tonight|today|what changed recently|latest changes?)\b"),
    ("schema", r"(?i)\b(schema|SearchHit|payload\.\w+|SurrealDB.*field|DEFINE FIELD)\b"),
    ("debugging", r"(?i)\b(test failure|vitest|mocking|500 error|debug)\b"),
    ("architecture", r"(?i)\b(write arbitration|pipeline|architecture|data flow)\b"),
    ("entity", r"(?i)\b(status of|state of|what is|tell me about|describe|overview of|details about)\b"),
    ("entity", r"(?i)\b(component|service|module|system|project|library|framework)\b"),
    ("entity", "状态|组件|服务|项目"),
    ("event", r"(?i)\b(happened|occurred|when did|timeline|history|deployed|shipped|released|launched)\b"),
    ("event", r"(?i)\b(yesterday|last week|last month|recently|earlier today)\b"),
    ("event", "发生|部署|发布|上线"),
)
LANES = {
    "session_opener": "session_opener", "current_status": "current_status", "latest_state": "latest_state", "exact_lookup": "exact_lookup", "recent_work": "recent_work",
    "decision_trace": "decision_trace", "exploratory_topic": "exploratory_topic", "workflow_posture": "workflow_posture", "architecture": "guidance_reference", "schema": "guidance_reference", "debugging": "recent_work",
}
LANE_WINDOW_HOURS = {"guidance_reference": 12, "workflow_posture": 18, "exact_lookup": 12, "recent_work": 24, "decision_trace": 18, "exploratory_topic": 48}
CATEGORY_OF_INTENT = {
    "preference": ("preferences", "profile"), "decision": ("cases", "patterns"), "entity": ("entities",), "event": ("events", "entities"),
    "current_status": ("events", "entities"), "recent_work": ("events", "cases"), "schema": ("entities", "cases"), "debugging": ("cases", "patterns"),
    "architecture": ("entities", "cases", "patterns"), "workflow_posture": ("events", "cases", "patterns"), "session_opener": ("events", "entities"),
    "latest_state": ("entities", "events"), "exact_lookup": ("entities", "cases"), "decision_trace": ("cases", "patterns"),
    "exploratory_topic": ("entities", "patterns"), "unknown_mixed": ("entities", "events"),
}
STATUS_SIGNALS = (r"(?i)\bcurrently\b", r"(?i)\bin progress\b", r"(?i)\bblocked\b", r"(?i)\bworking on\b", r"(?i)\btesting\b", r"(?i)\bdebugging\b", r"\b[A-Z]{2,5}-\d+\b")
NOISE_SIGNALS = (r"(?i)\bscout\b", r"(?i)\bbrief\b", r"(?i)\bdeploy(?:ed)?\b", r"(?i)\badmin(?:istrative)?\b", r"(?i)\bmaintenance\b", r"(?i)\bworkflow\b", r"(?i)\bhousekeeping\b", r"(?i)\bserver restart\b")
HISTORIC = (r"(?i)\bwas deployed\b", r"(?i)\bcompleted\b", r"(?i)\bshipped\b", r"(?i)\blaunched\b", r"(?i)\bfinished\b")
STATUS_ROLES = ("project_state", "current_status", "session_handoff", "recent_work", "debugging_active", "planning_active")

Stage = Callable[[DataFrame], DataFrame]


def run_plan(hits: DataFrame, stages: dict[str, Stage], order: list[str], disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Stages by name, in order; an unknown name is an error, a disabled one is skipped."""
    for name in order:
        if name not in stages:
            raise KeyError(f"unknown ranking stage: {name}")
        if name not in disabled:
            hits = hits.transform(stages[name])
    return hits


def intent(text: Column) -> Column:
    """The first matching intent; fact without a match."""
    out = F.lit("fact")
    for name, pattern in reversed(INTENTS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def lane(of_intent: Column) -> Column:
    out = F.lit("unknown_mixed")
    for name, to in LANES.items():
        out = F.when(of_intent == name, to).otherwise(out)
    return out


def null_path_penalty(hits: DataFrame, path: str | None) -> DataFrame:
    return hits.withColumn("score", F.col("score") * F.when(F.col("path").isNull(), 0.70).otherwise(1.0)) if path else hits


def category_boost(hits: DataFrame, intent_name: str) -> DataFrame:
    wanted = CATEGORY_OF_INTENT.get(intent_name, ())
    return hits.withColumn("score", F.col("score") * F.when(F.col("category").isin(*wanted), 1.15).otherwise(1.0)) if wanted else hits


def stale_demotion(hits: DataFrame, learned: DataFrame) -> DataFrame:
    """x 0.40 for texts that read as history, and for ids that were learned to be noise."""
    marked = hits.join(learned.select("id", F.lit(True).alias("learned")).distinct(), "id", "left")
    stale = tx.any_match(F.col("text"), HISTORIC) | F.col("learned").isNotNull()
    return marked.withColumn("score", F.col("score") * F.when(stale, 0.40).otherwise(1.0)).drop("learned")


def status_recency(hits: DataFrame, now: Column) -> DataFrame:
    """x 0.50 for rows older than seven days; a missing date is old."""
    old = F.coalesce(F.col("created_at") < now - F.expr("INTERVAL 7 DAYS"), F.lit(True))
    return hits.withColumn("score", F.col("score") * F.when(old, 0.50).otherwise(1.0))


def half_life(created: Column, now: Column, days: float) -> Column:
    hours = (F.unix_seconds(now) - F.unix_seconds(created)) / 3600.0
    return F.pow(F.lit(0.5), hours / (24.0 * days))


def scope_match(path: str | None) -> Column:
    if not path:
        return F.when(F.col("path").isNotNull(), 0.5).otherwise(0.35)
    return F.when(F.col("path") == path, 1.0).when(F.col("path").isNull(), 0.35).otherwise(0.0)


def signals(text: Column) -> dict[str, Column]:
    """Status and noise as shares of three cues; historic only without a status cue."""
    status = tx.count_matches(text, STATUS_SIGNALS)
    return {
        "status": F.least(F.lit(1.0), status / 3.0),
        "noise": F.least(F.lit(1.0), tx.count_matches(text, NOISE_SIGNALS) / 3.0),
        "historic": F.when(status > 0, 0.0).when(tx.any_match(text, HISTORIC), 1.0).otherwise(0.0),
    }


def current_status(hits: DataFrame, by: list[str], now: Column, path: str | None = None) -> DataFrame:
    """The weighted status score; semantic scores are relative to the query's best (1 at least)."""
    best = F.greatest(F.max("score").over(Window.partitionBy(*by)), F.lit(1.0))
    s = signals(F.col("text"))
    role = F.when(F.col("memory_role").isin(*STATUS_ROLES), 1.0).otherwise(0.4)
    valid = F.when(F.col("memory_role").isNull() | F.col("invalid_at").isNotNull(), 0.0).otherwise(1.0)
    total = (
        0.30 * F.col("score") / best + 0.18 * half_life(F.col("created_at"), now, 7) + 0.15 * s["status"] + 0.10 * scope_match(path)
        + 0.15 * role + 0.05 * valid + 0.07 * F.when(s["status"] > 0, 1.0).otherwise(0.0) - 0.15 * s["noise"] - 0.05 * s["historic"]
    )
    return hits.withColumn("score", total)


def status_filter(hits: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a status role or cue if a query has two or more of them; else all but operational noise."""
    strict = F.col("memory_role").isin(*STATUS_ROLES) | (signals(F.col("text"))["status"] > 0)
    known = hits.withColumn("strict", strict).withColumn("n_strict", F.count_if("strict").over(Window.partitionBy(*by)))
    keep = F.when(F.col("n_strict") >= 2, F.col("strict")).otherwise(F.coalesce(F.col("memory_role") != "operational_noise", F.lit(True)))
    return known.where(keep).withColumn("mode", F.when(F.col("n_strict") >= 2, "strict").otherwise("fallback")).drop("strict", "n_strict")


def policy_score(hits: DataFrame, by: list[str], now: Column, primary: tuple[str, ...], path: str | None = None) -> DataFrame:
    best = F.greatest(F.max("score").over(Window.partitionBy(*by)), F.lit(1.0))
    role = F.when(F.col("memory_role").isin(*primary), 1.0).otherwise(0.3)
    disposition = F.when(F.coalesce("active", F.lit(True)), 1.0).otherwise(0.0)
    total = 0.42 * F.col("score") / best + 0.20 * role + 0.13 * scope_match(path) + 0.10 * half_life(F.col("created_at"), now, 14) + 0.15 * disposition
    return hits.withColumn("score", total)


def admit(hits: DataFrame, by: list[str], barred: tuple[str, ...], caps: dict[str, int]) -> DataFrame:
    """Barred groups go; capped groups keep their best few."""
    place = F.row_number().over(Window.partitionBy(*by, "memory_role").orderBy(F.desc("score"), "id"))
    limit = F.lit(1 << 30)
    for group, most in caps.items():
        limit = F.when(F.col("memory_role") == group, most).otherwise(limit)
    known = hits.where(~F.col("memory_role").isin(*barred)).withColumn("place", place)
    return known.where(F.col("place") <= limit).drop("place")


def promote_primary(hits: DataFrame, by: list[str], primary: tuple[str, ...]) -> DataFrame:
    """rank with the best row of a primary group moved to the top, if there is one."""
    is_primary = F.col("memory_role").isin(*primary)
    first = F.row_number().over(Window.partitionBy(*by, is_primary).orderBy(F.desc("score"), "id"))
    known = hits.withColumn("lead", (is_primary & (first == 1)).cast("int"))
    return known.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("lead"), F.desc("score"), "id"))).drop("lead")


def frame_fit(text: Column, role: Column, goals: list[str], topics: dict[str, float], role_weights: dict[str, float]) -> Column:
    """0.6 share of the frame's words + 0.25 topic bias + 0.15 role weight."""
    held = F.size(F.array_intersect(tx.tokens(text), F.lit(goals))) / max(len(goals), 1)
    topic = sum((F.when(F.contains(F.lower(text), F.lit(t)), max(w, 0.0)).otherwise(0.0) for t, w in topics.items()), F.lit(0.0)) / max(len(topics), 1)
    weight = F.lit(0.0)
    for name, w in role_weights.items():
        weight = F.when(role == name, w).otherwise(weight)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return clamp(0.6 * held + 0.25 * clamp(topic) + 0.15 * clamp(weight))


def calibrated(fit: Column) -> Column:
    return 1 / (1 + F.exp(-6 * (fit - 0.5)))


def ambiguity_gate(ranked: DataFrame, by: list[str], window: int, epsilon: float) -> DataFrame:
    """(by.., gate): 1 if the gap after rank `window` is within epsilon or there is no such rank, 0 from 4 epsilon on, linear between."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    gap = F.greatest(at(window) - at(window + 1), F.lit(0.0))
    edge = ranked.groupBy(*by).agg(gap.alias("gap"))
    gate = F.when(F.col("gap").isNull() | (F.col("gap") <= epsilon), 1.0).when(F.col("gap") >= 4 * epsilon, 0.0).otherwise((4 * epsilon - F.col("gap")) / (3 * epsilon))
    return edge.withColumn("gate", gate)


def frame_rerank(ranked: DataFrame, by: list[str], fit: Column, window: int = 5, epsilon: float = 0.02, strength: float = 0.1) -> DataFrame:
    """score + gate x strength x fit x 0.25 for the first window rows of each query; new ranks."""
    gates = ambiguity_gate(ranked, by, window, epsilon)
    boosted = ranked.join(gates.drop("gap"), by).withColumn("score", F.col("score") + F.when(F.col("rank") <= window, F.col("gate") * strength * fit * 0.25).otherwise(0.0))
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).drop("gate")


def latest_state(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order: one window with a group limit."""
    known = rows.withColumn("state_key", key)
    return known.withColumn("n", F.row_number().over(Window.partitionBy("state_key").orderBy(*order))).where("n = 1").drop("n")
