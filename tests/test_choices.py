"""Greedy choices and signals, by hand and against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from palimpsest.operators import choices as ch


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


def test_batch_losers_as_a_loop(spark):
    rng = random.Random(3)
    rows = [(i // 12, i, rng.choice([0.5, 0.7, 0.9]), [rng.random() + 0.3 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "batch int, id long, confidence double, embedding array<double>")
    got = {r["id"] for r in ch.batch_losers(df, ["batch"], 0.95).collect()}
    gone = set()
    for batch in range(5):
        facts = [r for r in rows if r[0] == batch]
        for i, x in enumerate(facts):
            if x[1] in gone:
                continue
            for y in facts[i + 1 :]:
                if y[1] in gone or cosine(x[3], y[3]) <= 0.95:
                    continue
                if x[2] >= y[2]:
                    gone.add(y[1])
                else:
                    gone.add(x[1])
                    break
    assert gone and got == gone


def test_compaction_as_a_loop(spark):
    rng = random.Random(5)
    rows = [("u", i, i % 9 != 0, 0.5 + rng.randrange(5) / 10, [rng.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, id long, active boolean, confidence double, embedding array<double>").withColumn("created_at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int))"))
    now = F.to_timestamp(F.lit("2024-03-01"))
    got = {(r["id"], r["winner"]) for r in ch.compacted(df, now, 0.97, 40).collect()}
    scanned = sorted([r for r in rows if r[2]][:40], key=lambda r: (-r[3], r[1]))
    expected, taken = set(), set()
    for seed in scanned:
        if seed[1] in taken:
            continue
        members = [m for m in scanned if m[1] != seed[1] and m[1] not in taken and cosine(seed[4], m[4]) >= 0.97]
        if members:
            taken |= {seed[1]} | {m[1] for m in members}
            expected |= {(m[1], seed[1]) for m in members}
    assert expected and got == expected


def test_cycles(spark):
    chain = [("u", i, i - 1 if i else None) for i in range(60)] + [("v", 1, 2), ("v", 2, 3), ("v", 3, 1), ("v", 9, 404)]
    pointers = spark.createDataFrame(chain, "user_id string, id long, next long")
    asked = [("u", 100, 48), ("u", 100, 49), ("u", 5, 20), ("u", 20, 5), ("u", 7, 7), ("u", 1, None), ("v", 50, 1), ("v", 50, 9), ("v", 50, 48)]
    proposed = spark.createDataFrame(asked, "user_id string, id long, target long")
    got = {(r["user_id"], r["id"], r["target"]): r["cycle"] for r in ch.would_cycle(proposed, pointers).collect()}
    assert got == {("u", 100, 48): False, ("u", 100, 49): True, ("u", 5, 20): True, ("u", 20, 5): False, ("u", 7, 7): True, ("v", 50, 1): True, ("v", 50, 9): False, ("v", 50, 48): False}


def test_packet_passes_over_what_does_not_fit(spark):
    rows = [
        ("q", 1, "never share a token", 0.5, "cases", 1), ("q", 2, "x" * 400 + " must", 0.9, "cases", 2), ("q", 3, "> I like   tests", 0.2, "preferences", 3),
        ("q", 4, "nothing to see", 0.9, "cases", 4), ("r", 5, "y" * 4000, 0.9, "profile", 1), ("q", 6, None, 0.9, "cases", 5),
    ]
    df = spark.createDataFrame(rows, "q string, id long, text string, score double, category string, place int")
    assert [tuple(r) for r in ch.preference_packet(df, ["q"], 60).collect()] == [("q", 8, [1, 3], 1)]


def test_signals(spark):
    df = spark.createDataFrame([(["project:atlas", "role:tech_lead", "person:ann"], ["Project:Atlas", "role:tech-lead", "person:bob", "Update"]), (["project:a"], ["subject:b"]), (None, ["subject:b"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(ch.correction_marker(b), ch.same_slot(a, b), ch.conflicting_subjects(a, b), ch.changed_subjects(a, b)).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True), (False, False, True, False), (False, False, False, False)]


def test_claims(spark):
    pairs = [("active", "conflicted"), ("conflicted", "active"), ("superseded", "active"), ("rejected", "rejected"), ("odd", "active")]
    df = spark.createDataFrame(pairs, "a string, b string")
    allowed = ch.allowed_transition(ch.claim_status(F.col("a")), ch.claim_status(F.col("b")))
    assert [r[0] for r in df.select(allowed).collect()] == [True, True, False, True, True]
