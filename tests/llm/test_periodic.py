"""Runs against a plain search of every period, on words that repeat in many ways."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from palimpsest.llm import periodic

SMALL = "/root/testdata/sf0.01"


def plain_runs(words: list, shortest: int) -> list[tuple[int, int, int]]:
    """Every (start, end, period): periods from the least, stretches inside one of a shorter period left out."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i >= p and not any(s <= i and j + p <= e for s, e, _ in found):
                found.append((i, j + p, p))
            i = j + 1
    return sorted((s, e, p) for s, e, p in found if e - s >= max(shortest, 2 * p))


def strings(rng: random.Random, n: int) -> list[list[bytes]]:
    """Random, periodic, nested and Fibonacci words, touching regions of one period among them."""
    out = []
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for _ in range(n):
        kind = rng.randrange(6)
        alphabet = "ab" if rng.random() < 0.5 else "abcdefgh"
        word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))  # noqa: B023, E731
        if kind == 0:
            text = word(rng.randrange(0, 200))
        elif kind == 1:
            u = word(rng.randrange(1, 40))
            text = word(rng.randrange(5)) + (u * 12)[: rng.randrange(1, 12 * len(u) + 1)] + word(rng.randrange(5))
        elif kind == 2:  # a region of a short period inside a longer one
            q = word(rng.randrange(1, 4))
            u = q * rng.randrange(3, 30) + word(rng.randrange(0, 3))
            text = word(rng.randrange(4)) + u * rng.randrange(2, 4) + word(rng.randrange(4))
        elif kind == 3:  # touching regions
            q = word(rng.randrange(1, 6))
            text = "".join((q * 40)[rng.randrange(len(q)) :][: rng.randrange(2, 90)] for _ in range(rng.randrange(2, 5)))
        elif kind == 4:
            a = rng.randrange(300)
            text = fib[-1][a : a + rng.randrange(300)]
        else:
            u = "".join((word(rng.randrange(1, 4)) * 20)[: rng.randrange(1, 30)] for _ in range(3))
            text = u + u + word(1) + u[: rng.randrange(len(u) + 1)]
        out.append([c.encode() for c in text])
    return out


@pytest.mark.parametrize("shortest", [12, 20])
def test_runs_are_those_of_a_plain_search(shortest):
    texts = strings(random.Random(shortest), 1500)
    found, kept = periodic.block_runs(texts, shortest)
    for words, runs, stays in zip(texts, found, kept, strict=True):
        expected = plain_runs(words, shortest)
        assert [tuple(r) for r in runs.tolist()] == expected, b"".join(words)
        dropped = {i for s, e, p in expected for i in range(s + p, e)}
        assert stays.tolist() == [i not in dropped for i in range(len(words))]


def test_chosen_positions_are_dense_and_consistent():
    rng = random.Random(3)
    words = [rng.choice("abcdefgh").encode() for _ in range(4000)]
    words[2000:2600] = words[1000:1600]
    numbers = {w: i for i, w in enumerate(sorted(set(words)))}
    t = periodic.np.array([numbers[w] for w in words] + [-1])
    names = periodic.Names(t, lambda n: len(t), 0)
    none = periodic.np.zeros((0, 3), int)
    for k in (2, 3, 4, 5):
        chosen = periodic.synchronised(names, k, len(t), none)
        assert max(b - a for a, b in zip(chosen, chosen[1:], strict=False)) <= 1 << k
        assert len(chosen) < 4 * len(words) / (1 << k)
        inside = {c for c in chosen if 1000 <= c <= 1600 - (2 << k)}
        assert {c + 1000 for c in inside} == {c for c in chosen if 2000 <= c <= 2600 - (2 << k)}


def test_a_clash_of_names_is_found_and_done_again(monkeypatch):
    calls = []
    real = periodic.mixed
    monkeypatch.setattr(periodic, "mixed", lambda a: (calls.append(1), real(a) & periodic.np.uint64(7 if len(calls) < 12 else 2**64 - 1))[1])
    words = [c.encode() for c in "abcdefgabcdefgabcdefgxyzqwertyuiop"]
    assert [tuple(r) for r in periodic.block_runs([words], 12)[0][0].tolist()] == plain_runs(words, 12)


def expected_row(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    best = min(((s - e, s, p) for s, e, p in runs), default=None)
    dropped = {i for s, e, p in runs for i in range(s + p, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
    return *head, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_the_query_against_the_plain_search(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    docs = docs[docs["text"].str.len() < 6000]
    table = spark.createDataFrame(docs[["doc_id", "text"]])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic.digests(periodic.collapse_runs(table, prepare=periodic.tandem_copies)).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs[["doc_id", "text"]].itertuples(index=False, name=None):
        assert got[doc_id] == expected_row(doc_id, text), doc_id


def test_hard_rows(spark, docs, clashing, empty):
    query = lambda d: periodic.digests(periodic.collapse_runs(d, prepare=periodic.tandem_copies))
    rows = query(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        if r["doc_id"] not in (10, 11):
            assert tuple(r[c] for c in COLUMNS) == expected_row(r["doc_id"], texts[r["doc_id"]])
    assert sorted(map(str, query(clashing).collect())) == sorted(map(str, rows))
    assert query(empty).count() == 0
    blank = periodic.collapse_runs(docs.where("doc_id = 6")).first()
    assert blank["runs"] == [] and blank["text"] == ""


def test_very_long_texts(spark):
    text = "one two three " * 300_000 + "and " * 50_000 + " ".join(f"w{i % 70_001}" for i in range(200_000))
    rows = periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in rows["runs"]] == [(0, 900_000, 3), (900_000, 50_000, 1), (950_000, 200_000, 70_001)]
    assert len(rows["text"].split(" ")) == 3 + 1 + 70_001
