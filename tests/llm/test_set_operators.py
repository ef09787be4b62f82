"""Jaccard join, top-k search, mixing and packing against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import jaccard, mixing, packing, topk
from palimpsest.llm.components import components
from tests.llm.conftest import rows


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Families of edited copies at all distances, short and long, with a passage that all of them share."""
    rng = random.Random(seed)
    passage = " ".join(f"shared{i}" for i in range(55))
    out = []
    for size in (1, 2, 4, 5, 6, 8, 12, 30, 70, 160, 400):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 20):
            words = list(base)
            for _ in range(edits):
                at = rng.randrange(len(words) + 1)
                if rng.random() < 0.5 and words:
                    words[min(at, len(words) - 1)] = rng.choice(["x", "y", f"n{rng.randrange(50)}"])
                else:
                    words.insert(at, f"i{rng.randrange(9)}")
            text = " ".join(words)
            out.append((len(out) * 3 + 1, text + (" " + passage if rng.random() < 0.2 else "")))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_is_exact(spark, seed):
    docs = near_copies(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == brute_components(docs)
    assert dict(zip(got["doc_id"], got["n_shingles"], strict=True)) == {i: len(shingle_set(t)) for i, t in docs}


def test_jaccard_on_real_rows(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]]
    got = jaccard.jaccard_components(spark.createDataFrame(docs)).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == brute_components(list(docs.itertuples(index=False, name=None)))


def test_jaccard_edges(spark, docs, clashing, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    got = jaccard.jaccard_components(clashing).toPandas()
    assert len(got) == len(rows())
    by_id = dict(zip(got["doc_id"], got["component_id"], strict=True))
    assert by_id[2] == 1 and by_id[11] == 10 and by_id[4] == 4 and by_id[5] == 5 and by_id[6] == 6 and by_id[7] == 7


def test_sets_hash_whole_texts():
    shingler = jaccard.Shingler()
    long = " ".join(f"w{i}" for i in range(400_000))
    short = "\tA b\x0bC  d\ne "
    one, two, three = shingler.sets([long, short, short.upper()])
    assert len(one) == 399_996 and len(two) == 1 and (two == three).all()


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "u long, v long")
    assert {(r["node"], r["component"]) for r in components(links).collect()} == {*((i, 0) for i in range(1, 41)), (90, 80)}


def brute_top(vectors: list[tuple], every: int, k: int) -> list[tuple[int, int, int, int]]:
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (37, 3)])
def test_topk_is_exact(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * 0.05]) for i in range(300)]
    vectors += [(i, [1.0] * 8) for i in range(300, 420)]  # one very common vector: ties go to the smaller id
    vectors += [(450, None), (500, [float("nan")] * 8), (550, [None] * 8), (600, [1.0, 2.0]), (650, [0.5, 0.5]), (700, []), (None, [1.0] * 8), (750, [1e18] * 8), (751, [1e18] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    got = topk.top_k(df, data_rows=blocks[0], query_rows=blocks[1]).collect()
    clipped = lambda rows: sorted((q, r, i, max(min(s, topk.LONG[1]), topk.LONG[0])) for q, r, i, s in rows)
    small = [v for v in vectors if v[0] not in (750, 751)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>"), data_rows=blocks[0], query_rows=blocks[1]).collect())) == clipped(brute_top(small, 50, 5))
    assert len(got) > 0
    assert topk.top_k(df.limit(0)).count() == 0


def test_cover_tree_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([c + rng.normal(size=(300, 6)) * 0.01 for c in rng.normal(size=(8, 6))])).astype(np.int64)
    search = topk.Search(np.arange(5) * 500, x[::500][:5], np.arange(len(x)), x, 5)
    compared = []
    plain = search.compare
    search.compare = lambda r, c: (compared.append(len(r) * len(c)), plain(r, c))[1]
    search.run()
    assert sum(compared) < 5 * len(x)
    assert len(search.balls.nodes) > 8 and search.pruned > len(search.q_ids)  # whole balls go unseen
    assert search.compared.sum() < 0.2 * 5 * len(x)


def test_cover_tree_on_the_given_vectors():
    """Many nodes; distances concentrate, so that single rows are pruned and no ball of several is."""
    x = np.array(pq.read_table("/root/testdata/sf0.01/embeddings.parquet")["embedding"].to_pylist(), np.float64)
    v = np.floor(256 * x).astype(np.int64)
    search = topk.Search(np.arange(0, len(v), 50), v[::50], np.arange(len(v)), v, 5)
    search.run()
    assert len(search.balls.nodes) > 20
    assert search.compared.sum() < 0.25 * len(v[::50]) * len(v)
    scores = v[::50] @ v.T
    for row, (q, found) in enumerate(zip(search.q_ids, search.best, strict=True)):
        assert found == sorted((-int(s), i) for i, s in enumerate(scores[row]) if i != q)[:5]


def check_packing(found: pd.DataFrame, capacity: int) -> int:
    ordered = found.sort_values(["sequence_id", "offset"])
    starts = ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]
    assert (starts == ordered["offset"]).all()
    used = found.groupby("sequence_id")["length"].sum()
    assert used.max() <= capacity
    return len(used)


def test_packing_round_trip(spark, sf_dir):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]]
    extra = pd.DataFrame({"doc_id": [10**6, 10**6 + 1, 10**6 + 2], "text": [None, "", "plain <|endoftext|> é 漢字 \x00 tail"]})
    docs = pd.concat([docs, extra], ignore_index=True)
    found = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    tokenizer = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    expected = {}
    for doc_id, text in docs.itertuples(index=False, name=None):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, piece] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.itertuples()}
    assert got == expected
    n = check_packing(found, 1024)
    lower = -(-found["length"].sum() // 1024)
    assert n <= 1.05 * lower + 1


def test_packing_plan_is_tight():
    rng = random.Random(3)
    histogram = Counter(rng.randrange(1, 1024) for _ in range(20_000))
    found = packing.plan(histogram, 1024)
    used = Counter()
    for lengths, repeats in found:
        assert sum(lengths) <= 1024
        for length in lengths:
            used[length] += repeats
    assert used == histogram
    # no two pieces over half a sequence share one
    lower = max(sum(k * v for k, v in histogram.items()) / 1024, sum(v for k, v in histogram.items() if k > 512))
    assert sum(r for _, r in found) <= 1.01 * lower + 2


def test_packing_edges(docs, clashing, empty):
    assert packing.pack(empty).count() == 0
    found = packing.pack(clashing).toPandas()
    assert found["doc_id"].isna().any() and len(found[found["doc_id"] == 7]) == 2
    check_packing(found, 1024)


def brute_fill(pool: int, caps: list[int]) -> list[int]:
    """Equal weights: full children first, the rest share what is left in whole tokens."""
    out, left, open_ = {}, pool, sorted(range(len(caps)), key=lambda i: caps[i])
    while open_ and caps[open_[0]] * len(open_) <= left:
        out[open_[0]] = caps[open_[0]]
        left -= caps[open_.pop(0)]
    return [out.get(i, max(left, 0) // len(open_) if open_ else 0) for i in range(len(caps))]


def test_budgets_flow_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s3", 50), ("b", "en", "s4", 2000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    from pyspark.sql import functions as F

    got = {r["source"]: int(r["budget"]) for r in mixing.leaf_budgets(df, F.expr("cast(1600 as decimal(38,0))"), 1).collect()}
    a, b = brute_fill(1600, [1150, 2000])
    en, de = brute_fill(a, [1100, 50])
    s1, s2 = brute_fill(en, [100, 1000])
    assert got == {"s1": s1, "s2": s2, "s3": de, "s4": b} == {"s1": 100, "s2": 650, "s3": 50, "s4": 800}


def test_mixing_takes_prefixes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low, high = (mixing.mix(docs, share=s, epochs=3).toPandas().set_index("doc_id")["copies"] for s in (0.3, 1.5))
    assert all(high.get(i, 0) >= c for i, c in low.items()) and high.max() >= 2
    weighted = mixing.mix(docs, share=0.3, weights={("d1",): 5}).toPandas()
    assert weighted["tokens"].sum() <= 0.3 * mixing.mix(docs, share=1.0, epochs=1).toPandas()["tokens"].sum()


def test_mixing_edges(docs, clashing, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    whole = mixing.mixed_documents(clashing, share=1.0, epochs=1)
    assert whole.columns == clashing.columns
    wordy = [r for r in rows() if r[1] and r[1].split()]
    assert whole.where("trim(text) <> ''").count() >= len(wordy) - 3


def test_documents_are_counted_by_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b",), ("  a\tb \n",), ("",), (None,), (" ",), ("a b",)], "text string")
    assert [r["n"] for r in df.select(mixing.tokens(F.col("text")).alias("n")).collect()] == [2, 2, 0, 0, 0, 1]


def test_groups_are_classes(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (3, "A B C D E F"), (9, "x")], "doc_id long, text string")
    found = defaultdict(set)
    for r in jaccard.jaccard_components(docs).collect():
        found[r["component_id"]].add(r["doc_id"])
    assert found == {3: {3, 5}, 9: {9}}
