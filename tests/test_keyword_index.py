"""The kept keyword index: rows of the scan, blocks left out, appends, lost builds."""

from __future__ import annotations

import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import keyword_index as ki
from palimpsest.operators import retrieval as rt
from palimpsest.operators.keyword_index import KeywordIndex, left_out
from palimpsest.plans.recall import TERMS
from palimpsest.sources.tables import memory_units

SCHEMA = "id long, text string, text_norm string"


def shown(df):
    return [(r["id"], r["rank"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


def corpus(spark, n=4000):
    """Frequent words everywhere, rare ones in a few rows, lengths from none to 400 words; ties by repeated texts."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        length = draw.choice([0, 3, 20, 20, 60, 400])
        text = " ".join(draw.choices(words, [1 / (j + 1) for j in range(300)], k=length))
        rows.append((i, text + (" rare" * draw.choice([1, 3]) if i % 97 == 0 else ""), None))
    rows = [(i, t, t.lower()) for i, t, _ in rows]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, rows[97][1], rows[97][2])], SCHEMA)


def test_rows_of_the_scan_and_fewer_postings(spark, tmp_path):
    memories = corpus(spark).cache()
    index = KeywordIndex(spark, f"file://{tmp_path}/index", per_segment=25)
    index.append(memories.where("id < 1000"))
    index.append(memories.where("id >= 1000"))
    index.append(memories)  # all of it is there
    assert index.statistics().n == memories.count()
    shares = {}
    for terms in (["rare"], ["w0"], ["rare", "w0", "w1"], ["w0", "w1", "w2", "w3"], ["w50", "w0", "absent"]):
        distinct = list(dict.fromkeys(terms))
        found, read = index.search(terms, 10)
        assert shown(found) == shown(rt.bm25_leg(memories, distinct, 10)), terms
        shares[" ".join(terms)] = read["read"] / read["postings"]
    assert shares["w0"] < 0.3 and shares["rare w0 w1"] < 0.6 and all(s <= 1 for s in shares.values()), shares
    assert index.search(["absent"], 10)[0].collect() == []
    found, _ = index.search(["rare"], 1000)
    assert shown(found) == shown(rt.bm25_leg(memories, ["rare"], 1000))


def test_a_term_in_every_row_lies_in_blocks(spark, tmp_path):
    memories = corpus(spark).where("text is not null").select("id", F.concat(F.lit("hot "), "text").alias("text"), F.concat(F.lit("hot "), "text_norm").alias("text_norm"))
    index = KeywordIndex(spark, f"file://{tmp_path}/index", per_segment=200)
    index.append(memories)
    sizes = index.blocks.where("term = 'hot'").agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] < 300 and sizes[1] == memories.count()


def test_a_lost_build_is_not_read_and_equal_ids_count_once(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    assert index.search(["one"], 5)[0].collect() == [] and index.statistics().n == 0
    index.append(spark.createDataFrame([(1, "one two", "one two"), (1, "one three", "one three"), (None, "one", "one"), (2, None, None)], SCHEMA))
    assert [r["id"] for r in index.search(["one"], 5)[0].collect()] == [1] and index.search(["three"], 5)[0].count() == 1
    lost = index.blocks.drop("generation")
    lost.write.parquet(f"{index.path}/blocks/generation=lost")  # no row of its own in generations
    assert index.statistics().n == 2 and index.search(["one"], 5)[0].count() == 1
    index.append(spark.createDataFrame([], SCHEMA))
    assert index.statistics().n == 2


def test_what_is_left_out_stays_below_the_floor():
    draw = random.Random(5)
    for _ in range(200):
        levels = {(t, at): (draw.randrange(1, 100), draw.random() * 5 / (at + 1)) for t in "abcd" for at in range(5) if draw.random() < 0.8}
        floor = draw.random() * 8
        out, most = left_out(levels, floor)
        assert sum(most.values()) < floor or not out
        for t, at in levels:
            if (t, at) in out:
                assert levels[(t, at)][1] <= most[t] and all(x in out for x in levels if x[0] == t and x[1] > at)


def test_the_given_memories(spark, sf_dir, tmp_path):
    memories = memory_units(spark, sf_dir, ())
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    index.append(memories)
    assert shown(index.search(TERMS, 20)[0]) == shown(rt.bm25_leg(memories, TERMS, 20))


def shuffled(spark):
    """Bytes of all shuffles so far."""
    time.sleep(1)  # the status store lags behind
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_build_shuffles_ids_only(spark, tmp_path):
    memories = corpus(spark).repartition(4).cache()
    n = memories.count()
    index = KeywordIndex(spark, f"file://{tmp_path}/index", per_segment=400)
    for part in (memories.where("id % 4 <> 0"), memories.where("id % 4 = 0")):
        before = shuffled(spark)
        index.append(part)
        assert shuffled(spark) - before < 60 * n  # 24 for an id; texts and postings took ten times as much
    assert index.rows.count() == index.rows.distinct().count() == n
    assert shown(index.search(["rare", "w0", "w1"], 10)[0]) == shown(rt.bm25_leg(memories, ["rare", "w0", "w1"], 10))


def test_of_known_and_repeated_ids_each_is_indexed_once(spark, tmp_path):
    memories = corpus(spark, 300)
    index = KeywordIndex(spark, f"file://{tmp_path}/index", per_segment=50)
    index.append(memories.where("id < 100"))
    later = spark.createDataFrame([(7, "rare rare", "rare rare"), (7, "rare", "rare"), (150, None, None), (150, "zz", "zz")], SCHEMA)
    index.append(memories.unionByName(later))  # ids below 100 are known, 150 comes three times, 7 is known and comes three times
    kept = memories.where("id = 150").unionByName(later.where("id = 150")).orderBy(F.asc_nulls_last("text")).limit(1)
    expected = memories.where("id <> 150").unionByName(kept).cache()
    assert index.statistics().n == expected.count() == index.rows.count()
    for terms in (["rare"], ["zz"], ["w0", "w5"]):
        assert shown(index.search(terms, 20)[0]) == shown(rt.bm25_leg(expected, terms, 20)), terms


def test_a_segment_is_the_plain_count(monkeypatch):
    draw = random.Random(9)
    bags = [[draw.choice(["b", "a", "é", "zz", "\U0001f600", "ab"]) for _ in range(draw.choice([0, 1, 9, 200]))] for _ in range(80)] + [None]
    ids = draw.sample(range(-50, 10**12), len(bags))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bags, pa.list_(pa.string()))], ["id", "bag"])

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(ki, "TaskContext", Task)
    monkeypatch.setattr(ki, "ROWS_AT_ONCE", 7)
    for held, per_segment, n_segments in ((64 << 20, 1000, 1), (64 << 20, 10, 9), (2000, 1000, None)):
        monkeypatch.setattr(ki, "HELD", held)
        segments = list(ki.inverter(per_segment, 20.0)(iter([batch.slice(0, 33), batch.slice(33)])))
        assert len(segments) == n_segments if n_segments else len(segments) > 3
        assert len({tuple(s["segment"].to_pylist()[:1]) for s in segments if s.num_rows}) == sum(s.num_rows > 0 for s in segments)
        found = []
        for blocks in map(pa.RecordBatch.to_pylist, segments):
            assert [(b["term"].encode(), b["level"]) for b in blocks] == sorted({(b["term"].encode(), b["level"]) for b in blocks})
            for b in blocks:
                rows = list(zip(b["ids"], b["tfs"], b["dls"], strict=True))
                assert rows == sorted(rows) and b["n"] == len(rows) <= per_segment and b["usual"] == 20.0
                weigh = [tf / (tf + rt.K1 * (1 - rt.B + rt.B * dl / 20)) for _, tf, dl in rows]
                assert (b["max_tf"], b["min_ratio"]) == (max(r[1] for r in rows), min(r[2] / r[1] for r in rows)) and math.isclose(b["max_share"], max(weigh))
                assert {min(max(math.floor(math.log2(1 / w - 1) * ki.PER_DOUBLING) + ki.LEVELS // 2, 0), ki.LEVELS - 1) for w in weigh} == {b["level"]}
                found += [(b["term"], *r) for r in rows]
        assert sorted(found) == sorted((t, i, bag.count(t), len(bag)) for i, bag in zip(ids, bags, strict=True) for t in set(bag or []))


def test_rows_without_words_and_a_word_of_a_million_letters(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([(1, None, None), (2, "", ""), (3, "?!", "?!")], SCHEMA))
    assert index.statistics().n == 3 and index.blocks.count() == 0 and index.search(["a"], 5)[0].count() == 0
    index.append(spark.createDataFrame([(4, "a" * 10**6 + " end", "a" * 10**6 + " end")], SCHEMA))
    assert [r["id"] for r in index.search(["end"], 5)[0].collect()] == [4] == [r["id"] for r in index.search(["a" * 10**6], 5)[0].collect()]
