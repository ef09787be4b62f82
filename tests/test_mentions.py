"""Mention candidates by hand, their lookup, scopes and expansion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import mentions as mn


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), ("at of", ["at of"]), ("Zoë", ["zoe"]),
        ("ask Maria about rail", ["maria", "ask maria", "maria about", "about rail", "ask maria about rail", "ask maria about", "maria about rail", "ask", "about", "rail"]),
    ],
)
def test_candidates(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(mn.candidates(F.col("t"))).first()[0]
    assert got == expected


def test_candidates_are_capped_and_filler_ends_go(spark):
    text = " ".join(f"word{i}" for i in range(40))
    row = spark.createDataFrame([(text,)], "t string").select(mn.candidates(F.col("t")).alias("all"), mn.candidates(F.col("t"), filler=["word0", "word39"]).alias("some")).first()
    assert len(row["all"]) == 16 and row["all"][:4] == [f"word{i} word{i + 1}" for i in range(35, 39)] and row["all"][4] == text
    assert not any(m.startswith("word0 ") and m != text or m.endswith(" word39") and m != text for m in row["some"])


def test_lookup_by_name_before_alias_and_no_more_than_allowed(spark):
    entities = spark.createDataFrame([(i, "maria", ["rail"]) for i in range(9)] + [(20, "rail", []), (21, "ask maria", ["maria"]), (22, "x", None)], "entity long, name_norm string, aliases_norm array<string>")
    texts = spark.createDataFrame([(1, "ask Maria about rail"), (2, "nobody here"), (3, None)], "id long, text string")
    got = [tuple(r) for r in mn.mentioned(texts, entities, ["id"], most=11).collect()]
    assert sorted(got) == sorted([(1, i, "maria", "name") for i in range(9)] + [(1, 20, "rail", "name"), (1, 21, "ask maria", "name")])
    assert {r["entity"] for r in mn.mentioned(texts, entities, ["id"]).collect()} == set(range(6))


def test_lookup_scopes(spark):
    rows = spark.createDataFrame([("user", None), ("session", "a"), ("session", "b"), ("team", None), (None, None)], "scope string, session string")
    seen = lambda wanted, session: [tuple(r) for r in rows.where(mn.lookup_scope(F.col("scope"), F.col("session"), wanted, session)).collect()]
    assert seen("team", "a") == [] and seen("session", None) == [] and seen("session", "a") == [("session", "a")]
    assert seen("user", "a") == [("user", None), ("session", "a")] and seen("user", None) == [("user", None), ("session", "a"), ("session", "b")]


def test_expansion_takes_first_terms_of_all_facets_first(spark):
    facets = spark.createDataFrame([("a", ["rail"], ["train", "track gauge", "third"]), ("b", ["road", "rail"], ["Train", "lane", "fourth", "fifth"]), ("c", ["sea"], ["ship"])], "facet string, signals array<string>, terms array<string>")
    queries = spark.createDataFrame([(1, "by rail"), (2, "by sea ship"), (3, "nothing"), (4, None)], "query_id long, text string")
    got = {r["query_id"]: r["expanded"] for r in mn.expanded(queries, facets).collect()}
    assert got == {1: "by rail\ntrain track gauge lane third", 2: "by sea ship", 3: "nothing", 4: None}


def spoken(text):
    """Every mention of a text, in plain Python: the whole text and the runs of one to four words that aren't stop words."""
    words = [w for w in text.lower().split() if w not in tx.STOPWORDS]
    return {m for m in [text.lower(), *(" ".join(words[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1))] if len(m) >= 3}


def test_every_run_of_a_long_text_is_a_candidate(spark):
    text = " ".join(f"word{i}" for i in range(60))
    got = spark.createDataFrame([(text,), (None,)], "t string").select(mn.candidates(F.col("t"), most=None)).collect()
    assert set(got[0][0]) == spoken(text) and len(got[0][0]) == len(spoken(text)) == 1 + 60 + 59 + 58 + 57 and got[1][0] == []


def test_a_long_text_is_linked_with_all_that_it_names(spark):
    texts = {1: " ".join(f"word{i}" for i in range(60)), 2: "word30 word31 and word59", 3: "nobody here", 4: None}
    entities = [(i, f"word{i} word{i + 1}", [f"word{i}", "here"] if i % 3 else None) for i in range(59)] + [(100 + i, "word30 word31", ["word30"]) for i in range(20)] + [(200, None, ["nobody"])]
    expected = {(k, e, m, via) for k, text in texts.items() if text for e, name, also in entities for m, via in [(name, "name"), *((a, "alias") for a in also or [])] if m in spoken(text)}
    frame = spark.createDataFrame(entities, "entity long, name_norm string, aliases_norm array<string>")
    asked = spark.createDataFrame([*texts.items(), *texts.items()], "id long, text string")  # a text twice is no other link
    rows = mn.linked(asked, frame, ["id"]).collect()
    called = {}
    for r in rows:
        if r["id"] is None:
            assert r["entities"] is None
            called.setdefault((r["mention"], r["via"]), set()).add(r["entity"])
    assert {(r["id"], e, r["mention"], r["via"]) for r in rows if r["id"] for e in called[r["mention"], r["via"]]} == expected
    links = [r for r in rows if r["id"]]
    assert all((r["entity"], r["entities"]) == (min(c := called[r["mention"], r["via"]]), len(c)) for r in links)
    assert len(links) == len({(k, m, via) for k, _, m, via in expected}) and max(r["entities"] for r in links) > 20
    # the first entities of a text are the first of all that it names, also those in its middle
    assert sorted((r["id"], r["entity"], r["via"]) for r in mn.mentioned(asked, frame, ["id"], most=4).collect()) == [(1, 0, "name"), (1, 1, "name"), (1, 2, "name"), (1, 3, "name"), (2, 30, "name"), (2, 100, "name"), (2, 101, "name"), (2, 102, "name"), *((3, i, "alias") for i in (1, 2, 4, 5))]


def test_the_query_cuts_neither_mentions_nor_entities(spark, tmp_path):
    from palimpsest.plans import mentions
    from tests.oracle import connect, duck_rows, spark_rows

    text = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(0, 0, "user", text), (0, 1, "user", None)], "conv_id long, turn long, role string, text string").coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    documents = [(i, f"Word{i} word{i + 1} word{i + 2} and more") for i in range(58)] + [(100 + i, "word30 word31 word32") for i in range(20)]
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    found = mentions.entity_mentions(spark, str(tmp_path))
    rows = found.where("turn = 0").collect()
    assert {(r["mention"], r["via"], r["entity"], r["entities"]) for r in rows} == {(f"word{i} word{i + 1}", "name", i, 21 if i == 30 else 1) for i in range(58)} | {(f"word{i + 2}", "alias", i, 21 if i == 30 else 1) for i in range(58)}
    names, expected = duck_rows(connect(str(tmp_path)), mentions.R.sql["entity_mentions"])
    assert names == sorted(found.columns) and spark_rows(found) == expected and found.where("turn is null").count() == 2 * len(documents)
