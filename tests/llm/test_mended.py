"""Cases that earlier versions got wrong."""

from __future__ import annotations

import pytest

from palimpsest.llm import jaccard, langid, pii

WORDS = " ".join(f"w{i}" for i in range(80))


def test_near_copies_without_an_id_link(spark):
    rows = [(1, WORDS), (None, WORDS + " tail"), (None, "one two three four five six"), (5, WORDS + " tail more"), (None, "one two three four five six seven eight nine ten" * 3), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 2, 0), (0, 11, 0), (0, 77, 1), (1, 76, 1), (5, 78, 1)]
    only = spark.createDataFrame([(None, WORDS + " tail"), (9, "x y"), (3, WORDS + " other end"), (None, WORDS)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(only).collect()} == {(None, 3), (3, 3), (9, 9)}


FORMS = [
    "reach badc:eedd:beef:cafe:babe:fade:face:feed now", "at fe::ab it is", "mail Some.One@Example.com", "call (555) 123-4567", "call +49 30 1234567", "IBAN DE89370400440532013000",
    "from 10.0.0.7", "ssn 123-45-6789", "card 4111 1111 1111 1111", "Dear Mr. O'Neil and Frau Müller-Lüdenscheidt", "My name is John Smith", "Меня зовут Анна", "nothing here",
]


def test_every_form_is_replaced_alike_in_both_branches(spark):
    docs = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    few = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.pseudonymise(docs).collect()}
    assert few == {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.pseudonymise(docs, broadcast_entities=0).collect()}
    assert all(text != FORMS[i] and n for i, (text, n) in few.items() if i < len(FORMS) - 1) and few[len(FORMS) - 1] == (FORMS[-1], 0)


def test_names_keep_the_case_of_each_letter(spark):
    text = pii.pseudonymise(spark.createDataFrame([(1, FORMS[9])], "doc_id long, text string")).first()["text"]
    first, second = text.removeprefix("Dear Mr. ").split(" and Frau ")
    assert [c.isupper() for c in first] == [c.isupper() for c in "O'Neil"] and first[1] == "'" and first != "O'Neil"
    assert [c.isupper() for c in second] == [c.isupper() for c in "Müller-Lüdenscheidt"] and second[6] == "-"


@pytest.mark.parametrize("text", ["²", "½ ① 12", "Ⅷ", "12 !?", "", None])
def test_numerals_are_no_letters(spark, text):
    docs = spark.createDataFrame([(i, f"some words of lang {i % 2} {'ab' if i % 2 else 'xy'}", str(i % 2)) for i in range(40)] + [(99, text, "0")], "doc_id long, text string, lang string")
    row = langid.identify(docs).where("doc_id = 99").first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_twelve_hundred_languages(spark):
    code = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, " ".join([code(i // 4)] * 6), f"l{i // 4}") for i in range(4800)]
    langs, matrix = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=10)
    assert len(langs) > 1150 and matrix.shape == (len(langs), 1024) and langs == sorted(langs)
