"""Hand-computed cases and invariants of the operators that SQL cannot check."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vec
from palimpsest.operators import arbitration as ar
from palimpsest.operators import graph as gr
from palimpsest.operators import lifecycle as lc
from palimpsest.operators import predicates as pr
from palimpsest.operators import ranking as rk
from palimpsest.operators import retrieval as rt


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(vec.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, None]


@pytest.mark.parametrize(
    ("text", "key", "value"),
    [
        ("The deploy port is 8080", "the deploy port", "8080"),
        ("User has moved to Denver, which is now home", "user has", "denver, which is now home"),
        ("x is 1", "x is 1", "1"),
        ("one two three four five six seven eight nine", "one two three four five six seven eight", "one two three four five six seven eight nine"),
    ],
)
def test_statements(spark, text, key, value):
    assert one(spark, tx.statement_key(F.col("t")), t=text) == key
    assert one(spark, tx.statement_value(F.col("t")), t=text) == value


def test_supersedes_needs_the_same_key(spark):
    s = lambda a, b: one(spark, ar.supersedes(F.col("a"), F.col("b")), a=a, b=b)
    assert s("The deploy port is 8080", "The deploy port is 9090")
    assert not s("The deploy port is 8080", "The other port is 9090")
    assert not s("The deploy port is 8080", "The deploy port is 8080 today")


def test_merged_text(spark):
    m = lambda a, b: one(spark, ar.merged_text(F.col("a"), F.col("b")), a=a, b=b)
    assert m("A b.", "a  b.") == "A b."
    assert m("one two", "zero one two three") == "zero one two three"
    assert m("First. Second.", "Second. Third.") == "First. Second. Third."


def test_skip_gate_order(spark):
    s = lambda t: one(spark, pr.skips_retrieval(F.col("t")), t=t)
    assert [s("hi"), s("do you remember"), s("/status please do it"), s("thanks!"), s("How does the deploy pipeline work?"), s("short text")] == [True, False, True, True, False, True]


def test_scope_without_ids_is_empty(spark):
    df = spark.createDataFrame([("session", "s1", None), ("team", None, "t1"), ("user", None, None), (None, None, None)], "scope string, session_id string, team_id string")
    count = lambda *a, **k: df.where(pr.in_scope(*a, **k)).count()
    assert [count("session"), count("team"), count("user"), count("default"), count("default", session_id="s1"), count("all")] == [0, 0, 2, 2, 3, 4]


def test_fusion_ignores_leg_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    key = lambda legs: sorted((r["id"], round(r["score"], 12)) for r in rt.fuse(legs).collect())
    assert key({"vector": a, "bm25": b}) == key({"bm25": b, "vector": a})
    assert dict(key({"vector": a, "bm25": b}))[2] == round(1 / 62 + 1.2 / 61, 12)


def test_unknown_stage_is_an_error(spark):
    with pytest.raises(KeyError):
        rk.run_plan(spark.range(1), {}, ["missing"])


def test_near_pairs_recall(spark):
    rows = [("u", i, [float((i * 7 + j * 3) % 11) + (0.01 * i if j == 0 else 0.0) for j in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id string, id long, embedding array<double>")
    a, b = df.alias("a"), df.alias("b")
    exact = a.join(b, F.col("a.id") < F.col("b.id")).where(vec.cosine(F.col("a.embedding"), F.col("b.embedding")) >= 0.99).count()
    assert ar.near_pairs(df, "user_id", 0.99).count() >= 0.9 * exact


def test_registered_near_pairs_are_all_pairs(spark, sf_dir):
    from palimpsest.plans import arbitration
    from palimpsest.sources.tables import memory_units

    path = sf_dir.replace("0.001", "0.01")
    rows = [(r["user_id"], r["id"], np.array(r["embedding"], float)) for r in memory_units(spark, path).select("user_id", "id", "embedding").where("embedding is not null").collect()]
    cos = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y)))
    expected = {(a, b): cos(x, y) for t, a, x in rows for u, b, y in rows if t == u and a < b and cos(x, y) >= 0.35}
    got = {(r["a"], r["b"]): r["similarity"] for r in arbitration.near_pairs_lsh(spark, path).collect()}
    assert len(expected) > 0 and got == pytest.approx(expected, abs=1e-6)


def test_near_pairs_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [("t" if i % 3 else "u", i, rng.normal(size=4 if i % 10 else 3).tolist()) for i in range(300)]
    rows += [("t", 300, None), ("t", 301, []), ("t", 302, [0.0] * 4), (None, 303, rows[0][2]), ("t", 1, rows[1][2])]
    unit = {(t, i): np.array(v) / np.linalg.norm(v) for t, i, v in rows[:300]}
    expected = {(a, b) for (t, a), x in unit.items() for (u, b), y in unit.items() if t == u and a < b and len(x) == len(y) and x @ y >= 0.5}
    got = [(r["a"], r["b"]) for r in ar.near_pairs(spark.createDataFrame(rows, "user_id string, id long, embedding array<double>"), "user_id", 0.5, block=7).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    found = {r["id"]: r["cluster"] for r in gr.clusters(pairs).collect()}
    assert set(found.values()) == {0, 100} and found[30] == 0


def brute_pairs(edges, least=2, jaccard=0.3):
    sets = {}
    for entity, i in edges:
        sets.setdefault(i, set()).add(entity)
    shared = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    return {(a, b, n) for (a, b), n in shared.items() if n >= least and n / (len(sets[a]) + len(sets[b]) - n) > jaccard}


def test_pairs_and_clusters_of_all_edges(spark, sf_dir):
    from palimpsest.plans import analytics

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    expected = brute_pairs(map(tuple, rows))
    assert {(r["a"], r["b"], r["shared"]) for r in analytics.entity_jaccard_edges(spark, sf_dir).collect()} == expected
    root = {i: i for a, b, _ in expected for i in (a, b)}
    while any(root[a] != root[b] for a, b, _ in expected):
        for a, b, _ in expected:
            root[a] = root[b] = min(root[a], root[b])
    sizes = {c: sum(r == c for r in root.values()) for c in root.values()}
    assert {r["cluster"]: r["n"] for r in analytics.clusters(spark, sf_dir).collect()} == sizes


def test_shared_pairs_in_cells(spark):
    rng = np.random.default_rng(2)
    edges = [(0, i) for i in range(80)] + [(int(e), int(i)) for e, i in zip(rng.integers(1, 9, 300), rng.integers(0, 90, 300), strict=True)]
    got = gr.shared_pairs(spark.createDataFrame(edges, "entity long, id long"), block_ids=7).collect()
    expected = brute_pairs(edges)
    assert len(got) == len(expected) and {(r["a"], r["b"], r["shared"]) for r in got} == expected


def test_fact_keys(spark):
    from palimpsest.operators import capture as cp

    def key(category, text):
        h = 5381
        units = text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 33 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        return h, f"{h:08x}"[-6:]

    texts = {"The Café is open, Now": "the-is-open-now-", "one": "", "  Two words ": "two-words-", "a b c d e f g h": "a-b-c-d-e-f-", "smile 😀 now": "smile-now-", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cp.fact_key(F.lit("cases"), F.col("t")).alias("k"), cp.djb2(F.col("t")).alias("h")).collect()
    for r in rows:
        h, code = key("cases", r["t"])
        assert r["h"] == h and r["k"] == f"cases:{texts[r['t']]}{code}"


def test_fixed_lists(spark):
    from palimpsest.operators import capture as cp
    from palimpsest.operators import predicates as pr
    from palimpsest.operators import ranking as rk

    for text, cue in (("the Resume Point is here", True), ("handoff committed to docs/handoffs/ today", True), ("see docs/handoffs/a.md", False), ("we left off there", False)):
        assert one(spark, pr.has_handoff_cue(F.col("t")), t=text) is cue
    for text, intent in (("how should we structure the pipeline data flow", "architecture"), ("show the schema of it", "schema"), ("MIM-12", "recent_work"), ("我的偏好", "preference"), ("发布", "event"), ("nothing of note", "fact")):
        assert one(spark, rk.intent(F.col("t")), t=text) == intent
    for text, score in (("收到。", 0.1), ("👍", 0.1), ("谢谢", 0.1), ("thanks!", 0.1)):
        assert one(spark, cp.message_score(F.col("t")), t=text) == score
    assert one(spark, pr.skips_retrieval(F.col("t")), t="😀🎉😀🎉😀🎉😀🎉😀🎉😀🎉😀🎉😀🎉") is True


def test_confidence_floor_of_null_and_unknown(spark):
    from palimpsest.operators import predicates as pr

    rows = spark.createDataFrame([(None,), ("other",), ("cases",), ("profile",)], "category string").select(pr.confidence_floor().alias("f")).collect()
    assert [r["f"] for r in rows] == [0.7, 0.95, 0.8, 0.7]


def test_bands_on_near_copies(spark):
    """Planted near copies at the ladder's own thresholds."""
    from palimpsest.operators import arbitration as ar

    at = lambda h: dt.datetime(2024, 6, 1) - dt.timedelta(hours=h)
    tilt = lambda c: [c, (1 - c * c) ** 0.5]
    store = [(1, "the port is 80", [1.0, 0.0], at(10))]
    new = {2: ("The  port is 80", 1.0), 3: ("the port is 8443", 0.9), 4: ("quite near to it", 0.96), 5: ("port is 80", 0.9), 6: ("other words of some kind", 0.9), 7: ("other words", 0.8), 8: ("ABC-1 moved", 0.9)}
    schema = "id long, text string, embedding array<double>, created_at timestamp, user_id string"
    old = spark.createDataFrame([(*r, "u") for r in store] + [(11, "ABC-2 moved", [0.0, 1.0], at(10), "v")], schema)
    rows = spark.createDataFrame([(i, t, tilt(c), at(1), "u") for i, (t, c) in new.items() if i != 8] + [(8, "ABC-1 moved", [0.3, 0.95], at(1), "v")], schema)
    got = {r["id"]: (r["decision"], r["target"]) for r in ar.decide(ar.candidates(rows, old), rows).collect()}
    assert got == {2: ("1_skip_exact", 1), 3: ("2_supersede", 1), 4: ("3_skip_near", 1), 5: ("4_skip_contained", 1), 6: ("5_merge", 1), 7: ("6_create", None), 8: ("6_create", None)}


def test_merge_prefers_changes(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, lc.merge(current, changes, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_vitality_stays_within_bounds(spark):
    now = dt.datetime(2024, 6, 1)
    rows = [(t, c, a, now - dt.timedelta(hours=h), None, False) for t in ("ephemeral", "working", "durable", None) for c in (-1.0, 0.5, 2.0) for a in (0, 9) for h in (0, 5000)]
    df = spark.createDataFrame(rows, "tier string, confidence double, access_count int, created_at timestamp, last_accessed_at timestamp, pinned boolean")
    assert df.select(lc.vitality(F.lit("2024-06-01").cast("timestamp")).alias("v")).where("v < 0 or v > 1").isEmpty()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12))
def test_fingerprint_ignores_order(spark, ids):
    f = lambda x: one(spark, gr.fingerprint(F.col("a")), a=x)
    assert f(ids) == f(sorted(ids, reverse=True))
