"""The sweep in several batches, orphans, and the latest trace of captures."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from palimpsest.operators import upkeep as up
from palimpsest.plans.upkeep import planted

DAY = dt.datetime(2026, 1, 1)


def test_sweeps_in_batches_give_what_one_gives(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("written_at", F.date_trunc("day", "created_at")).cache()
    whole, through = up.sweep(rows)
    expected = {(r["id"], r["superseded_by"]) for r in whole.collect()}
    assert len(expected) > 10
    ends = {(r["user_id"], r["scope"]): r["watermark"] for r in through.collect()}
    found, marks = set(), None
    for _ in range(30):
        some, marks = up.sweep(rows, marks, most=4)
        marks = up.written(marks)
        found |= {(r["id"], r["superseded_by"]) for r in some.collect()}
        if {(r["user_id"], r["scope"]): r["watermark"] for r in marks.collect()} == ends:
            break
    assert {i for i, _ in found} == {i for i, _ in expected}
    assert up.sweep(rows, marks)[0].count() == 0  # nothing is due


def test_values_must_survive(spark):
    vector = [1.0, 0.0]
    texts = ["reply with PONG", "reply with READY", "port 80 and 443 and READY and PONG", "no value", "no value either"]
    rows = [(i, "u", "s", t, vector, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i)) for i, t in enumerate(texts)] + [(9, "u", None, "no value", vector, DAY, DAY), (10, "v", "s", None, None, DAY, DAY)]
    table = spark.createDataFrame(rows, "id long, user_id string, scope string, text string, embedding array<double>, created_at timestamp, written_at timestamp")
    assert {(r["id"], r["superseded_by"]) for r in up.sweep(table)[0].collect()} == {(0, 2), (1, 2), (3, 4)}
    assert up.sweep(table.where("false"))[0].count() == 0


def test_new_rows_meet_all_in_blocks_of_any_size(spark, sf_dir):
    rows = planted(spark, sf_dir).cache()
    new = rows.where("id >= 1000000")
    whole = {(r["new_id"], r["other_id"]) for r in up.near_new(new, rows, 0.5).collect()}
    cells = up.near_new(new, rows, 0.5, block=3).collect()
    assert len(cells) == len(whole) > 0 and {(r["new_id"], r["other_id"]) for r in cells} == whole


def test_latest_trace_of_a_hot_session(spark):
    rng = random.Random(6)
    traces = [(i, "u", "hot" if rng.random() < 0.5 else None, DAY + dt.timedelta(minutes=rng.randrange(20_000)), [i]) for i in range(300)]
    captures = [(i, "u", "hot" if rng.random() < 0.5 else None, DAY + dt.timedelta(minutes=rng.randrange(20_000))) for i in range(300)] + [(900, "u", "cold", DAY)]
    t = spark.createDataFrame(traces, "trace_id long, user_id string, session_id string, at timestamp, items array<long>")
    c = spark.createDataFrame(captures, "capture_id long, user_id string, session_id string, at timestamp")
    got = {r["capture_id"]: r["trace"] and r["trace"]["trace_id"] for r in up.latest_trace(c, t, ["user_id", "session_id"], bucket_seconds=7200).collect()}
    assert len(got) == len(captures)
    for i, _, session, at in captures:
        before = [(when, k) for k, _, s, when, _ in traces if s == session and when <= at]
        assert got[i] == (max(before)[1] if before else None)


def test_accrual_counts_and_ignores(spark):
    captures = spark.createDataFrame([("u", "s", DAY, "alpha beta gamma"), ("u", "s", DAY, " "), ("u", "s", DAY, None), ("x", "s", DAY, "alpha")], "user_id string, session_id string, at timestamp, answer string")
    traces = spark.createDataFrame([("u", "s", DAY, 1, [1, 1, 2, 77, None], True)], "user_id string, session_id string, at timestamp, trace_id long, items array<long>, status boolean")
    records = spark.createDataFrame([(1, "alpha beta gamma", 0.9), (2, "other words", None), (3, "never", 0.5)], "id long, text string, prior double")
    got = {r["id"]: (r["retrieved"], r["used"], r["successful"], r["status_retrieved"], r["status_used"]) for r in up.accrued(captures, traces, records, ["user_id", "session_id"]).collect()}
    assert got == {1: (1, 1, 1, 1, 1), 2: (1, 0, 0, 1, 0)}


def test_orphans_share_an_entity(spark):
    orphans = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [0.9, 0.1]), (3, "u", [0.0, 1.0]), (4, "v", [1.0, 0.0]), (5, "u", [1.0, 0.05])], "id long, user_id string, embedding array<double>")
    edges = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 1), (8, 1), (7, 3), (7, 4), (9, 5)], "entity long, id long")
    assert [(r["a"], r["b"], r["shared"]) for r in up.near_orphans(orphans, edges).collect()] == [(1, 2, 2)]
