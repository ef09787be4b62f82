"""All registered queries of the library and their SQL twins, collected from the plan modules."""

from __future__ import annotations

from palimpsest.plans import analytics, arbitration, capture, choices, decisions, indexes, lifecycle, mentions, ranking, recall, recall_many, records, scans, upkeep
from palimpsest.plans.registry import Query

PLANS = (recall, recall_many, scans, ranking, lifecycle, arbitration, analytics, capture, records, decisions, choices, upkeep, mentions, indexes)


def queries() -> dict[str, Query]:
    return {name: f for plan in PLANS for name, f in plan.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.R.sql.items()}
