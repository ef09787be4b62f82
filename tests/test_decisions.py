"""Decisions about writes and hits, against expectations written by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import decisions as dc


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


@pytest.mark.parametrize(
    ("text", "cue"),
    [
        ("We dropped Redux for Zustand", True),
        ("He dropped the ball for the team", False),
        ("switched directly over to Go", True),
        ("switch users to admin", False),
        ("moved on the proposal", False),
        ("Moved on to TypeScript", True),
        ("argued in favor of Postgres", False),
        ("", False),
    ],
)
def test_currentness_cue(spark, text, cue):
    assert values(spark, [(text,)], "t string", dc.currentness_cue(F.col("t"))) == [cue]


def test_memory_kind_prefers_the_stored_role(spark):
    rows = [("Blocked by CI", None), ("Blocked by CI", "project_state"), ("Blocked by CI", "deploy_ops"), ("nothing here", None), ("the plan is blocked", None)]
    assert values(spark, rows, "t string, r string", dc.memory_kind(F.col("t"), F.col("r"))) == ["debugging_active", "debugging_active", "deploy_ops", "recent_work", "debugging_active"]


def test_guards(spark):
    rows = [("durable", "ephemeral", "x"), ("durable", None, "only for now"), ("durable", None, "x"), ("durable", "durable", "today"), ("working", "ephemeral", "today")]
    assert values(spark, rows, "a string, b string, t string", dc.durability_reason(F.col("a"), F.col("b"), F.col("t"))) == ["ephemeral-over-durable", "transient-over-durable", None, None, None]
    times = [("2024-01-02", None), ("2024-01-02", ""), ("2024-01-02", "soon"), (None, "2024-01-01"), ("2024-01-02", "2024-01-01"), ("2024-01-02", "2024-01-02"), ("2025-01-01", None)]
    now = F.lit("2024-06-01").cast("timestamp")
    assert values(spark, times, "a string, b string", dc.ordering_reason(F.col("a"), F.col("b"), now)) == [None, None, "invalid-incoming-validAt", "invalid-candidate-time", "older-incoming", None, "older-incoming"]


def test_overlay(spark):
    rows = [("k", "s", "A b", " a  B "), ("k", "s", "A b c", "b"), ("k", "s", "one", "two"), (" ", "s", "one", "one"), (None, "s", "one", "one"), ("k", "s", None, "one")]
    assert values(spark, rows, "f string, s string, o string, n string", dc.overlay_outcome(F.col("f"), F.col("s"), F.col("o"), F.col("n"))) == ["skip", "merge-update", "supersede", "create", "create", "create"]
    durable = spark.createDataFrame([(1, True, 0.5, "old"), (2, False, 0.4, "old"), (3, True, 0.3, "old")], "id long, active boolean, score double, text string")
    overlay = spark.createDataFrame([(1, "new"), (2, "new"), (4, "new"), (5, "new"), (6, "new")], "id long, text string")
    records = spark.createDataFrame([(1, True), (2, True), (4, True), (5, False)], "id long, active boolean")
    got = {r.id: (r.score, r.text, r.from_overlay) for r in dc.overlay_merge(durable, overlay, records).collect()}
    assert got == {1: (0.5, "new", True), 2: (0.4, "old", False), 3: (0.3, "old", False), 4: (0.0, "new", True)}


def test_reranked(spark):
    hits = spark.createDataFrame([(1, 0.9, 0.5, False), (2, 0.9, 0.1, False), (3, 0.9, 0.1, True), (4, 0.9, None, True), (5, 0.9, None, None)], "id long, score double, rerank double, preserve boolean")
    assert {r.id: r.score for r in dc.reranked(hits, 0.3).collect()} == {1: 0.5, 3: 0.1, 4: 0.9}
    assert {r.id: r.score for r in dc.reranked(hits, 0.3, 0.35).collect()} == {1: 0.5, 3: 0.35, 4: 0.35}


def test_boundary_hash(spark):
    want = hashlib.sha256(b'\x01"a\\"\xc3\xa9"' + b"\x00" + b'\x01""').hexdigest()
    assert values(spark, [('a"é', None, "")], "a string, b string, c string", dc.boundary_hash(F.col("a"), F.col("b"), F.col("c"))) == [want]


def test_merged_entries(spark):
    rows = [(1, 2, "B\n a \n", 0.5, "x"), (1, 1, "A\nb2", 0.9, "y"), (1, 3, "c", None, "x"), (2, 4, "", None, None)]
    got = {r.cluster: r.asDict() for r in dc.merged_entries(spark.createDataFrame(rows, "cluster long, id long, text string, confidence double, category string")).collect()}
    assert got[1] == {"cluster": 1, "confidence": 0.9, "members": 3, "category": "x", "text": "A\nb2\nB\nc"}
    assert got[2]["text"] is None and got[2]["members"] == 1


def test_watermark_splits_no_tie(spark):
    rows = [("a", 1, True), ("a", 2, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("c", 5, True)]
    got = {r.u: r.watermark for r in dc.tie_safe_watermark(spark.createDataFrame(rows, "u string, at long, swept boolean"), ["u"]).collect()}
    assert got == {"a": 1, "b": None, "c": 5}


def test_compare_and_set(spark):
    states = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("d", 4, "x")], "key string, version long, value string")
    writes = spark.createDataFrame([("a", 1, "z"), ("a", 1, "y"), ("b", 1, "y"), ("c", None, "y"), ("e", 3, "y")], "key string, expected long, new_value string")
    got = {r.key: (r.version, r.value, r.applied) for r in dc.compare_and_set(states, writes).collect()}
    assert got == {"a": (2, "y", True), "b": (2, "x", False), "c": (1, "y", True), "d": (4, "x", False)}


def test_atomic_facts(spark):
    rows = [("S", "p", " V", "s ", "P", "V"), ("s", "p", "v", "s", "p", "V"), ("s|t", "p", "v", "s|t", "p", "v"), ("s", "p", None, "s", "p", "v")]
    got = values(spark, rows, "a string, b string, c string, d string, e string, f string", dc.atomic_action((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f"))))
    assert got == ["retain", "clear", "clear", "clear"]


def test_empty_tables(spark):
    assert dc.merged_entries(spark.createDataFrame([], "cluster long, id long, text string, confidence double, category string")).count() == 0
    assert dc.compare_and_set(spark.createDataFrame([], "key string, version long, value string"), spark.createDataFrame([], "key string, expected long, new_value string")).count() == 0


def test_write_scope(spark):
    rows = [(" session ", True, "s"), ("global", None, "s"), ("what", False, "s"), (" ", False, "s"), (None, True, "s"), (None, None, "s")]
    made = dc.write_scope(F.col("a"), F.col("l"), F.col("s"))
    got = values(spark, rows, "a string, l boolean, s string", F.struct(made["scope"], made["session_id"]))
    assert [tuple(r) for r in got] == [("session", "s"), ("global", None), ("user", None), ("session", "s"), ("user", None), ("user", None)]
