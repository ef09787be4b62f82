"""The inverted file: exact against all pairs, recall of the probed search, appends, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.operators.vector_index import VectorIndex
from palimpsest.plans.indexes import probes, vector_index

SCHEMA = "id long, embedding array<double>"


def clustered(n=1200, dim=16, clusters=24):
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(clusters, dim))
    return [(i, (middle[i % clusters] * draw.uniform(0.5, 2) + draw.normal(size=dim) * 0.25).tolist()) for i in range(n)]


def brute(rows, queries, k):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in queries:
        s = np.round(x @ (np.array(v) / np.linalg.norm(v)), 9)
        out[q] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def found(df):
    out: dict[int, list[int]] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def recall(some, whole):
    return sum(len(set(some.get(q, [])) & set(ids)) for q, ids in whole.items()) / sum(map(len, whole.values()))


def test_exact_and_probed_on_clusters_built_in_parts(spark, tmp_path):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index", block_rows=20, queries_per_block=7)
    index.train(df, 24, sample_rows=400)
    index.append(df.where("id < 700"))
    index.append(df)  # the first 700 are there already
    assert index.rows.count() == len(rows)
    asked = [r for r in rows if r[0] % 20 == 0]
    queries = spark.createDataFrame(asked, SCHEMA).withColumnRenamed("id", "query_id")
    expected = brute(rows, asked, 10)
    assert found(index.search(queries, 10, 1, exact=True)) == expected
    probes = index.calibrated(queries, 10, 0.95)
    assert recall(found(index.search(queries, 10, probes)), expected) >= 0.95
    assert index.share_read(queries, probes) < 0.35


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [0.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 4.0]), (9, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.train(df, 2)
    index.append(df.where("false"))
    queries = df.withColumnRenamed("id", "query_id")
    assert index.search(queries, 3, 1).collect() == []
    index.append(df)
    hits = found(index.search(queries, 3, 1, exact=True))
    assert hits == {1: [1, 2, 8], 2: [1, 2, 8], 8: [8, 1, 2]}
    bare = VectorIndex(spark, f"file://{tmp_path}/none")
    bare.train(df.where("false"), 4)
    bare.append(df)
    assert bare.search(queries, 3, 1).collect() == []


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_recall_on_the_given_vectors(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    exact = found(catalog.queries()["vector_index_exact"](spark, sf_dir))
    some = found(catalog.queries()["vector_index_topk"](spark, sf_dir))
    index, queries = vector_index(spark, sf_dir)
    share = index.share_read(queries, probes(spark, sf_dir, index))
    print("recall", recall(some, exact), "share of pairs", share)
    assert recall(some, exact) >= 0.9 and share < 1
    assert index.rows.agg(F.countDistinct("id")).first()[0] == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
