"""Shapes of plans: no join where nothing joined is read."""

from __future__ import annotations

import pytest

from palimpsest import catalog
from palimpsest.operators import retrieval as rt
from palimpsest.plans.recall import TERMS
from palimpsest.sources.tables import memory_units


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["corpus_stats", "tenant_active_scan", "time_window_scan", "skip_gate", "noise_facts", "recency_topk", "overlap_fallback"])
def test_scans_join_nothing(name, spark, sf_dir):
    assert "Join" not in plan(catalog.queries()[name](spark, sf_dir))


def test_term_counts_join_nothing_and_statistics_are_observed(spark, sf_dir):
    memories = memory_units(spark, sf_dir, ())
    assert "Join" not in plan(rt.term_counts(memories, TERMS))
    given = rt.bm25_leg(memories, TERMS, 20, rt.corpus_stats(memories)).collect()
    assert [(r["id"], round(r["score"], 9)) for r in rt.bm25_leg(memories, TERMS, 20).collect()] == [(r["id"], round(r["score"], 9)) for r in given]
    assert rt.bm25_leg(memories.where("false"), TERMS, 20).collect() == []
