"""Many queries against one at a time, the claim modes, exact questions and the collapse of contradictions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import collapse as cl
from palimpsest.operators import exact_qa
from palimpsest.operators import recall_many as rm
from palimpsest.operators import retrieval as rt
from palimpsest.plans.recall import now_col
from palimpsest.plans.recall_many import asked
from palimpsest.sources.tables import memory_units


def test_every_query_gets_what_it_gets_alone(spark, sf_dir):
    memories = memory_units(spark, sf_dir).cache()
    queries = asked(memories)
    got = {}
    for r in rm.hybrid(memories, queries, now_col(), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 8)))
    rows = queries.collect()
    assert len(got) == len(rows) > 1
    for q in rows:
        alone = rt.hybrid(memories, q["embedding"], tx.significant_tokens(q["text"]), now_col(), 10).collect()
        assert sorted(got[q["query_id"]]) == sorted((r["rank"], r["id"], round(r["score"], 8)) for r in alone)


def test_blocks_of_any_size_give_the_same(spark, sf_dir):
    memories = memory_units(spark, sf_dir).cache()
    queries = memories.where("id % 10 = 0").select(F.col("id").alias("query_id"), "text", "embedding")
    whole = sorted(rm.vector_leg(memories, queries, 5).collect())
    assert whole == sorted(rm.vector_leg(memories, queries, 5, memory_block=30, query_block=7).collect())


def test_vectors_of_another_length_score_nothing(spark):
    memories = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, None), (5, [])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (8, [3.0]), (9, None)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in rm.vector_leg(memories, queries, 9).collect()}
    assert got == {(q, i): float((q, i) in ((7, 1), (8, 2))) for q in (7, 8) for i in (1, 2, 3, 5)}


def test_claims_by_mode(spark):
    hits = spark.createDataFrame([(q, i, 0.5 - i / 10) for q in (1, 2, 3) for i in (1, 2, 3)], "query_id long, id long, score double")
    hits = hits.withColumn("claim_key", F.when(F.col("id") == 3, "k"))
    claims = spark.createDataFrame([(100, "k", [1, 9])], "id long, claim_key string, supports array<long>")
    found = spark.createDataFrame([(q, 100, 0.45) for q in (1, 2, 3, 4)], "query_id long, id long, score double")
    queries = spark.createDataFrame([(1, "primary"), (2, "annotation"), (3, "disabled"), (4, "annotation")], "query_id long, mode string")
    got = {}
    for r in rm.with_claims(hits, found, claims, queries, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["kind"], r["score"]))
    assert got == {1: [(100, "claim", 0.45), (2, "memory", 0.3)], 2: [(1, "memory", 0.4), (2, "memory", 0.3)], 3: [(1, "memory", 0.4), (2, "memory", 0.3)], 4: [(100, "claim", 0.27)]}


def test_rerank_preserves_exact_answers(spark):
    queries = spark.createDataFrame([(1, "which port does the cache use", [1.0, 0.0]), (2, "tell a story", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    texts = spark.createDataFrame(
        [("memory", 1, "the cache does use port 6379", [0.0, 1.0]), ("memory", 2, "a tale", [0.8, 0.6]), ("memory", 3, "far", [0.1, 1.0]), ("claim", 3, "the cache does use port 6379", None)],
        "kind string, id long, text string, embedding array<double>",
    )
    pool = spark.createDataFrame([(q, k, i, 0.02, 1) for q in (1, 2) for k, i in (("memory", 1), ("memory", 2), ("memory", 3), ("claim", 3))], "query_id long, kind string, id long, score double, rank int")
    read = lambda floor: {(r["query_id"], r["kind"], r["id"]): (r["score"], r["label"], r["preserved"]) for r in rm.reranked(pool, queries, texts, floor=floor).collect()}
    plain = read(None)
    assert plain == {(1, "memory", 2): (0.8, "direct", False), (2, "memory", 2): (0.8, "direct", False), (1, "memory", 1): (0.02, None, True), (1, "claim", 3): (0.02, None, True)}
    assert read(0.4)[1, "claim", 3] == (0.4, None, True)
    unscored = rm.reranked(pool.where("id <> 2 and query_id = 2"), queries, texts).collect()
    assert len(unscored) == 3 and {r["score"] for r in unscored} == {0.02}  # no cosine at all: the fused order stays


TEMPLATE = "User stated that the {} service in production runs on port {}. "
COMPOUND = "".join(TEMPLATE.format(name, 9000 + i) for i, name in enumerate(("mail", "queue", "login", "index")))
OLD, NEW = r"oldWrite\(\)", r"\bnewWrite\b"
CASES = [
    # compounds and answers to different questions stay
    ([("n", TEMPLATE.format("ledger", 9111), None, 0.9, 5), ("c", COMPOUND, None, 0.85, 1)], {"n", "c"}),
    ([("s", TEMPLATE.format("mail", 9000), None, 0.95, 5), ("c", COMPOUND, None, 0.85, 1)], {"s", "c"}),
    ([("a", "Ann birthday is 1980-05-06.", None, 0.9, 1), ("b", "Ben birthday is 1981-07-08.", None, 0.8, 1)], {"a", "b"}),
    # equal first sentences: the newer one; with a path first
    ([("a", "The store listens on port 4500. More on its setup.", None, 0.8, 1), ("b", "The store listens on port 4500. Later notes.", None, 0.85, 20)], {"b"}),
    ([("a", "The store listens on port 4500. More.", "/p", 0.8, 1), ("b", "The store listens on port 4500. Later.", None, 0.85, 20)], {"a"}),
    ([("a", "The store listens on port 4500.", None, 0.9, 1), ("b", "Vectors are kept as arrays of floats.", None, 0.8, 1)], {"a", "b"}),
    # renames: one weaker hit across the boundary goes
    ([("o", "All writes pass through oldWrite() for now.", None, 0.85, 10), ("n", "The entry is named newWrite these days.", "/p", 0.87, 29)], {"n"}),
    ([("l", "It was called oldWrite() before.", None, 0.82, 10), ("x", "newWrite looks into the cache first.", "/p", 0.95, 29), ("y", "newWrite joins near copies of three days.", "/p", 0.91, 28)], {"x", "y"}),
    # chains: the third meets the survivor of the first two; equals keep the first
    ([("a", "One thing here.", None, 0.9, 1), ("b", "One thing here.", None, 0.9, 1), ("c", "One thing here!", None, 0.9, 2)], {"c"}),
    ([("a", "One thing here.", None, 0.9, 1), ("b", "One thing here.", None, 0.9, 1)], {"a"}),
    ([("a", None, None, 0.9, 1), ("b", "", None, 0.8, 1), ("c", "!!", None, 0.7, 1)], {"a"}),
]


def test_collapse_of_contradictions(spark):
    rows = [(q, i, k + 1, text, path, None, dt.datetime(2026, 3, day), score) for q, (hits, _) in enumerate(CASES) for k, (i, text, path, score, day) in enumerate(hits)]
    hits = spark.createDataFrame(rows, "query_id long, id string, rank int, text string, path string, confidence double, dated timestamp, score double")
    got = {q: set() for q in range(len(CASES))}
    for r in cl.collapse(hits, [(OLD, NEW)]).collect():
        got[r["query_id"]].add(r["id"])
    assert got == {q: stay for q, (_, stay) in enumerate(CASES)}
    assert cl.collapse(hits.where("query_id = 6")).count() == 2  # without renames nothing contradicts


@pytest.mark.parametrize(
    ("a", "b", "distinct"),
    [
        ("- one\n- two", "- one\n- three", True), ("- one\n- two", "* one\n* two", False), ("The mail port is 25.", "The mail port is 26.", False),
        ("Ann birthday is 1980-05-06.", "Ben birthday is 1981-07-08.", True), ("Ann birthday is soon", "Ben birthday was 1981-07-08", False), ("Ann likes tea", "Ben likes 2 teas", False), ("", "", False),
    ],
)
def test_answer_distinctness(spark, a, b, distinct):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(exact_qa.answer_distinct(F.col("a"), F.col("b"))).first()[0]
    assert got is distinct


def test_value_tokens(spark):
    text = "PONG at 10.2.3, see `x y` in /etc/Hosts and main.py on 2026-01-02"
    got = spark.createDataFrame([(text,)], "t string").select(exact_qa.value_tokens(F.col("t"))).first()[0]
    assert {"pong", "10.2.3", "`x y`", "/etc/hosts", "main.py", "2026-01-02"} <= set(got)
