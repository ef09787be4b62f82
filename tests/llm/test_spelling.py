"""Words one edit apart, their forms and roots, against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.llm import spelling

SMALL = "/root/testdata/sf0.01"


def plain_near(words: set[str]) -> dict[str, set[str]]:
    """Pairs one edit apart, by every way to delete one letter."""
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            holes[i, short].add(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return near


def plain_variants(rows, one_in=199) -> dict[str, tuple]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = plain_near(set(n))
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def as_dict(df) -> dict[str, tuple]:
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 9]))) for _ in range(n)}
    long = "x" * 150 + "".join(rng.choice("ab") for _ in range(150))
    return sorted(words | {long, long[:40] + "c" + long[41:], long[:299], long + "a", "y" + long})


def test_near_pairs_in_cells_of_every_size(spark):
    words = random_words(2, 900)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    expected = {(w, v) for w, near in plain_near(set(words)).items() for v in near}
    number = {w: i for i, w in enumerate(words)}
    for bin_words, cells in ((2048, 8192), (10, 7), (100_000, 40)):
        rows = spelling.near_pairs(table, bin_words, cells).collect()
        assert len(rows) == len(expected) and {(r["word"], r["other"]) for r in rows} == expected
        assert all(r["other_n"] == number[r["other"]] for r in rows)


def test_whole_table_against_the_plain_version(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = as_dict(spelling.variants(spark.read.parquet(f"{SMALL}/documents.parquet"), slip_one_in=199))
    assert got == plain_variants(docs[["doc_id", "text"]].itertuples(index=False, name=None))
    assert sum(v[0] is not None for v in got.values()) > 50


def test_chains_ties_and_letters(spark):
    rows = [
        (1, "colour " * 700 + "Colour"), (2, "colours " * 120 + "colourss " * 20), (3, "ÀÉÎÖÜß " * 30 + "àéîöüß " * 6 + "àéîöü× " * 5), (4, None), (5, ""),
        (None, "planets " * 30 + "planete " * 30 + "planet " * 5), (7, "short shorts " * 9), (7, "short shorts " * 9), (8, "x" * 3000 + " " + ("x" * 3000 + " ") * 5),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("word", "n", "form", "other", "bin")})
    got = as_dict(spelling.variants(table))
    assert got == plain_variants(rows, one_in=1 << 40)
    assert got["colourss"][:2] == ("colours", "colour") and got["colours"][:2] == ("colour", "colour") and got["planet"][0] == "planete"
    assert got["àéîöü×"][0] == "àéîöüß" or got["àéîöü×"][0] is None
    assert as_dict(spelling.variants(table, slip_one_in=3)) == plain_variants(rows, one_in=3)


def test_hard_rows(spark, docs, clashing, empty):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = plain_variants(texts)
    assert as_dict(spelling.variants(docs, slip_one_in=199)) == expected == as_dict(spelling.variants(clashing, slip_one_in=199))
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(docs.where("text is null")).count() == 0


def test_task_counts_sent_on_early_are_the_same(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200)
    assert sorted(spelling.vocabulary(docs, hold=10).collect()) == sorted(spelling.vocabulary(docs).collect())
