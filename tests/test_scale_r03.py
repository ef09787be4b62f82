"""Steps that grew faster than their input in round 3: the same rows by blocks, in parts and with odd vectors."""

from __future__ import annotations

import datetime as dt

import numpy as np

from palimpsest.operators import arbitration as ar


def incoming(n=90):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(n, 4)).round(2).tolist()
    for i in range(0, n, 6):
        vectors[i] = vectors[0]  # copies: ties go to the smaller id
    vectors[7], vectors[8], vectors[9], vectors[13] = [], [0.0] * 4, [1.0, 2.0], None
    texts = ["port is 80" if i % 5 == 0 else f"row {i % 9} is {i % 4}" for i in range(n)]
    return [(i, "t" if i % 4 else "u", texts[i], vectors[i], dt.datetime(2024, 6, 1) - dt.timedelta(hours=i * 7 % 200)) for i in range(n)]


SCHEMA = "id long, user_id string, text string, embedding array<double>, created_at timestamp"


def test_nearest_by_blocks_is_brute_force(spark):
    rows = incoming()

    def cosine(a, b):
        scale = np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / scale if len(a) == len(b) and len(a) and scale > 0 else 0.0

    expected = set()
    for i, user, _, v, at in rows:
        hours = lambda other: (at - other).total_seconds() / 3600  # noqa: B023, E731
        near = [(-cosine(v, w), j) for j, u, _, w, then in rows if None not in (v, w) and u == user and i != j and 0 <= hours(then) <= 72]
        expected |= {(i, j, rank + 1, round(-s, 9) + 0.0) for rank, (s, j) in enumerate(sorted(near)[:5])}
    df = spark.createDataFrame(rows, SCHEMA)
    for block, at_once in ((4000, 20_000), (7, 30)):
        found = ar.nearest(df, df, block=block, at_once=at_once)
        assert not {"new_text", "old_text"} & set(found.columns)  # no text is shuffled with a pair
        got = found.collect()
        assert len(got) == len(expected)
        assert {(r["new_id"], r["old_id"], r["rank"], round(r["similarity"], 9) + 0.0) for r in got} == expected


def test_bands_read_texts_of_near_pairs_only(spark):
    df = spark.createDataFrame(incoming(), SCHEMA)
    plain = sorted(map(str, ar.decide(ar.candidates(df, df), df).collect()))
    assert len({r.split("decision=")[1][:6] for r in plain}) > 2
    assert sorted(map(str, ar.decide(ar.nearest(df, df, block=7), df, store=df).collect())) == plain


def test_shared_pairs_are_sent_by_rare_entities(spark):
    from palimpsest.operators import graph as gr

    # 40 copies of a small graph with keys of their own: an id is sent as often as it has rare entities, copies or not
    draw = np.random.default_rng(3)
    one = [(int(e), int(i)) for e, i in zip(draw.integers(0, 12, 200), draw.integers(0, 30, 200), strict=True)]
    frame = lambda k: spark.createDataFrame([(e + 12 * c, i + 30 * c) for c in range(k) for e, i in one], "entity long, id long").distinct()
    sent = [gr.prefix_groups(frame(k), 2, 0.3, 1500).count() for k in (1, 40)]
    assert sent[1] == 40 * sent[0]
    small, large = (gr.shared_pairs(frame(k)).collect() for k in (1, 40))
    assert len(small) > 5 and len(large) == 40 * len(small)
    assert {(r["a"], r["b"], r["shared"], r["jaccard"]) for r in large if r["a"] < 30} == set(map(tuple, small))


def test_keyword_leg_writes_k_rows_a_block(spark):
    from palimpsest.operators import recall_many as rm
    from pyspark.sql import functions as F

    # every record has the frequent word, and all queries ask for it
    rows = [(i, f"common word{i % 7} " + "common " * (i % 3), f"common word{i % 7} ") for i in range(400)] + [(400, None, None), (401, "?!", "?!")]
    memories = spark.createDataFrame(rows, "id long, text string, text_norm string")
    queries = memories.where("id % 20 = 0 and text is not null").select(F.col("id").alias("query_id"), "text")
    leg = rm.keyword_leg(memories, queries, 3)
    whole = sorted(leg.collect())
    assert len(whole) == 20 * 3 and whole == sorted(rm.keyword_leg(memories, queries, 3, memory_block=90, query_block=7).collect())
    assert "FlatMapCoGroupsInPandas" in leg._jdf.queryExecution().optimizedPlan().toString()


def test_reconciled_by_arrays_and_by_rows(spark):
    from palimpsest.operators import records as rc

    draw = np.random.default_rng(4)
    asked = [(int(g), int(i)) for g, i in zip(draw.integers(0, 60, 300), draw.integers(0, 40, 300), strict=True)] + [(60, i) for i in range(40)]
    held = [(int(c), int(i)) for c, i in zip(draw.integers(0, 15, 200), draw.integers(0, 45, 200), strict=True)] + [(c, 3) for c in range(15)]
    groups, clusters = {}, {}
    for of, pairs in ((groups, asked), (clusters, held)):
        for k, i in pairs:
            of.setdefault(k, set()).add(i)
    best = {g: min((-len(ids & of), c) for c, of in clusters.items()) for g, ids in groups.items()}
    expected = {(g, c, -n) for g, (n, c) in best.items() if n and -n >= 0.5 * len(groups[g])}
    frames = spark.createDataFrame(asked, "group long, id long"), spark.createDataFrame(held, "cluster long, id long")
    for limits in ((64, 256), (4, 8), (5, 256)):
        found = rc.reconciled(*frames, 0.5, *limits)
        assert set(map(tuple, found.collect())) == expected and found.count() == len(expected)
    # a group and an id's clusters meet as one row, not as one for each cluster
    assert "MapInPandas" in rc.reconciled(*frames)._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_of_many_entities_is_limited_before_it_meets_texts(spark):
    from palimpsest.operators import mentions as mn

    entities = [(i, "blue door", ["lamp", "cup"] if i % 2 else ["cup"]) for i in range(40)] + [(i, "red cup", ["door"]) for i in range(40, 43)] + [(i, "x", ["red cup"]) for i in range(30, 60)]
    texts = {1: "blue door", 2: "a red cup", 3: "lamp", 4: "cup red cup", 5: "nothing"}
    expected = set()
    for k, text in texts.items():
        said = set(mn_candidates(spark, text))
        by = {}
        for i, name, alias in entities:
            kinds = ([0] if name in said else []) + ([1] if said & set(alias) else [])
            if kinds:
                by[i] = min([*kinds, by.get(i, 9)])
        expected |= {(k, i, "alias" if b else "name") for b, i in sorted((b, i) for i, b in by.items())[:6]}
    frame = spark.createDataFrame([(i, n, a) for i, n, a in entities], "entity long, name_norm string, aliases_norm array<string>")
    found = mn.mentioned(spark.createDataFrame(list(texts.items()), "turn long, text string"), frame, ["turn"])
    assert {(r["turn"], r["entity"], r["via"]) for r in found.collect()} == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") + found._jdf.queryExecution().optimizedPlan().toString().count("row_number") >= 3


def mn_candidates(spark, text):
    from palimpsest.operators import mentions as mn
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(mn.candidates(F.col("t"))).first()[0]


def test_fact_keys_join_nothing_and_hash_in_batches(spark, sf_dir):
    from palimpsest.operators import capture as cp
    from palimpsest.plans import capture
    from pyspark.sql import functions as F

    plan = capture.fact_keys(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ArrowEvalPython" in plan
    texts = ["", "a", "Zoë 😀", "x" * 5000, None, "\x00"]

    def djb2(text):
        h, units = 5381, text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 33 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        return h

    got = [r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(cp.djb2(F.col("t")).alias("h")).collect()]
    assert got == [None if t is None else djb2(t) for t in texts]


def test_orphans_tell_apart_their_own_edges_only(spark, monkeypatch):
    from palimpsest.operators import upkeep as up
    from pyspark.sql import functions as F

    kept = []
    whole = up.written
    monkeypatch.setattr(up, "written", lambda df: kept.append(whole(df)) or kept[-1])
    orphans = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [1.0, 0.1]), (3, "u", [0.0, 1.0]), (4, "v", [1.0, 0.0])], "id long, user_id string, embedding array<double>")
    edges = spark.range(1000).select((F.col("id") % 10).alias("entity"), (F.col("id") % 50).alias("id"))
    found = up.near_orphans(orphans, edges.unionByName(edges.where("id in (1, 2)").withColumn("entity", F.lit(77))))
    assert [(r["a"], r["b"], r["shared"]) for r in found.collect()] == [(1, 2, 1)]
    assert {r["id"] for r in kept[-1].collect()} == {1, 2}
