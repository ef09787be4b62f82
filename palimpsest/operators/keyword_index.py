"""A keyword index kept in a folder: postings by term in blocks with maxima, grown by appending, and an exact
top k that stops by bound.

A build writes `rows/generation=<id>/` (the ids that it holds and their words), then one row a block, a term's postings
of one impact level and one segment: `blocks/generation=<id>/`: term, level, segment, n, max_tf, min_ratio, max_share,
usual, ids, tfs, dls (a segment is sorted by term and level, so that pages of other terms are passed by), and last
`generations/` (n rows, words in them). A generation without its last row, left by a lost job, is not read.
Level 0 has the postings that weigh most; a segment is what one task inverted at a time, `per_segment` ids and about
`HELD` bytes at most, so that a block is bounded, however frequent its term is.

Neither texts nor postings are shuffled: a text is tokenised and inverted where it is read, and its segment written by
the same task, so that an id is in one segment, also if a task is run again. Only ids travel, to find those that are
known or there twice. The memories are read more than once and must be the same each time.

A search reads the blocks' maxima first, never their lists: document frequencies, and an upper bound for each
(term, level). A posting weighs idf (K1 + 1) share, where 1 / share = 1 + K1 (1 - B) / tf + K1 B / avgdl dl / tf. The
share is largest for the largest tf and the smallest dl / tf; and where avgdl has drifted from the `usual` length of the
generation, 1 / share - 1 has shrunk by usual / avgdl at most. The smaller of both bounds counts. Then
1. the levels with the largest bounds are read until k rows or more have partial scores: the k-th best is a floor,
2. levels are left out, lowest first and longest list first, as long as a row that occurs in left out levels alone
   stays below the floor; the others are read,
3. rows whose partial score and what the left out levels can add stay below the floor go; what the rest have in
   left out levels is looked up, in the blocks of their segments alone.
The rows and scores are those of `retrieval.bm25_leg`. `n` counts all rows, lengths and frequencies are its.

Edge cases: a null text counts as a row and has no postings; a null id isn't indexed; an id that is in the index
already is left out of an append, so that an append may be repeated; of equal ids in one append one row is kept, the
first by its text; an index without rows, and a term that no row holds, give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import retrieval as rt
from palimpsest.operators.stored import small, written

#: Impact levels of a term, so many for each doubling of 1 / share - 1.
LEVELS, PER_DOUBLING = 32, 4
BLOCKS = "term string, level int, segment int, n long, max_tf long, min_ratio double, max_share double, usual double, ids array<long>, tfs array<long>, dls array<long>, generation string"
ROWS = "id long, generation string"
GENERATIONS = "generation string, n long, texts long, words long"
#: Bytes that a task holds to be inverted (8 a token and its text), and rows that are added at a time.
HELD, ROWS_AT_ONCE = 32 << 20, 50
#: Numbers of segments kept for each task; two segments of one number are looked up together.
NUMBERS = 4096
#: Added to bounds before they are compared: sums of doubles in another order.
SLACK = 1e-9


@dataclass(frozen=True)
class Statistics:
    n: int
    avgdl: float

    @property
    def a(self) -> float:
        return rt.K1 * (1 - rt.B)

    @property
    def b(self) -> float:
        return rt.K1 * rt.B / self.avgdl


def share(tf: np.ndarray, dl: np.ndarray, usual: float) -> np.ndarray:
    """What a posting weighs, of the most that one of its term can weigh, if texts have the usual length on average."""
    return tf / (tf + rt.K1 * (1 - rt.B + rt.B * dl / usual))


def level(share: np.ndarray) -> np.ndarray:
    """0 for the postings that weigh most, LEVELS - 1 for those that weigh least."""
    return np.clip(np.floor(np.log2(1 / share - 1) * PER_DOUBLING) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)


def inverted(rows: pa.Table, segment: int, usual: float) -> pa.RecordBatch:
    """The blocks of rows(id, bag), one segment, by term and level: each (term, row) sorted and counted, then cut."""
    rows = rows.sort_by("id").combine_chunks()
    ids, bags = rows["id"].to_numpy(), rows["bag"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(bags), 0).to_numpy().astype(np.int64)
    words = bags.flatten().dictionary_encode()
    in_order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(in_order), np.int64)
    place[in_order] = np.arange(len(in_order))
    keys = place[words.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    keys.sort()
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    term, row = np.divmod(keys[at], len(ids))
    tf = np.diff(at, append=len(keys))
    weigh = share(tf, lengths[row], usual)
    group = term * LEVELS + level(weigh)
    order = np.argsort(group, kind="stable")  # ids stay in order
    group, row, tf, weigh = group[order], row[order], tf[order], weigh[order]
    at = np.flatnonzero(np.diff(group, prepend=-1))
    dl, ends = lengths[row], pa.array(np.append(at, len(group)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (ids[row], tf, dl)]
    term, ratio = words.dictionary.take(pa.array(in_order[group[at] // LEVELS])).cast(pa.string()), dl / tf
    best = [np.maximum.reduceat(tf, at), np.minimum.reduceat(ratio, at), np.maximum.reduceat(weigh, at)] if len(at) else [tf, ratio, weigh]
    columns = [term, pa.array(group[at] % LEVELS, pa.int32()), pa.array(np.full(len(at), segment), pa.int32()), pa.array(np.diff(at, append=len(group))), *map(pa.array, best), pa.array(np.full(len(at), usual)), *lists]
    return pa.RecordBatch.from_arrays(columns, ["term", "level", "segment", "n", "max_tf", "min_ratio", "max_share", "usual", "ids", "tfs", "dls"])


def inverter(per_segment: int, usual: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of (id, bag): a task's rows, segment by segment as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held, rows, size = TaskContext.get().partitionId() * NUMBERS, [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, min(ROWS_AT_ONCE, per_segment - rows))
                held.append(some)
                at, rows, size = at + some.num_rows, rows + some.num_rows, size + some.nbytes + 8 * len(some["bag"].flatten())
                if size >= HELD or rows >= per_segment:
                    yield inverted(pa.Table.from_batches(held), segment % 2**31, usual)
                    segment, held, rows, size = segment + 1, [], 0, 0
        if held:
            yield inverted(pa.Table.from_batches(held), segment % 2**31, usual)

    return run


class KeywordIndex:
    """An index in a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, per_segment: int = 65_536) -> None:
        self.spark, self.path, self.per_segment = spark, path, per_segment

    def _exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        if name == "generations":
            return self.spark.read.schema(schema).parquet(f"{self.path}/generations")
        whole = [r["generation"] for r in self._read("generations", GENERATIONS).select("generation").collect()]  # one row an append
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("generation").isin(whole))

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    @property
    def rows(self) -> DataFrame:
        return self._read("rows", ROWS)

    def statistics(self) -> Statistics:
        found = self._read("generations", GENERATIONS).agg(F.sum("n"), F.sum("texts"), F.sum("words")).first()
        n, texts, words = (v or 0 for v in found)
        return Statistics(n, words / texts if texts else 1.0)

    def append(self, memories: DataFrame) -> str:
        """Indexes the rows of memories(id, text, text_norm) whose id the index doesn't have; the generation's name."""
        generation = uuid.uuid4().hex
        fresh = self._fresh(memories.where("id is not null").select(F.col("id").cast("long").alias("id"), "text", "text_norm"))
        rows, words = f"{self.path}/rows/generation={generation}", rt.words("text_norm").cast("long")
        fresh.select("id", words.alias("words")).write.parquet(rows)
        counted = self.spark.read.schema("id long, words long").parquet(rows)
        done = counted.agg(F.count("*").alias("n"), F.count("words").alias("texts"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        usual = float(done["words"] / done["texts"] if done["words"] else 1.0)
        bags = fresh.select("id", tx.tokens(F.col("text")).alias("bag"))
        blocks = bags.mapInArrow(inverter(self.per_segment, usual), BLOCKS.removesuffix(", generation string"))
        blocks.write.option("parquet.block.size", 8 << 20).parquet(f"{self.path}/blocks/generation={generation}")
        self.spark.createDataFrame([(generation, *done)], GENERATIONS).write.mode("append").parquet(f"{self.path}/generations")
        return generation

    def _fresh(self, memories: DataFrame) -> DataFrame:
        """The rows whose id the index doesn't have, one for each id. Only ids are shuffled, but for rows whose id is
        there more than once; where there are too many ids to leave out for a broadcast, their join shuffles texts."""
        ids = memories.select("id", F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(self.rows.select("id", F.lit(0).alias("new"), F.lit(1).alias("old")))
        counted = ids.groupBy("id").agg(F.sum("new").alias("new"), F.max("old").alias("old"))
        odd = written(counted.where("new > 1 or (new = 1 and old = 1)").select("id", "old"))
        if odd.isEmpty():
            return memories
        one = Window.partitionBy("id").orderBy(F.asc_nulls_last("text"), F.asc_nulls_last("text_norm"))
        twice = memories.join(small(odd.where("old = 0").select("id")), "id", "left_semi")
        firsts = twice.withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy")
        return memories.join(small(odd.select("id")), "id", "left_anti").unionByName(firsts)

    def plan(self, terms: Sequence[str], stats: Statistics) -> tuple[dict[str, float], dict[tuple[str, int], tuple[int, float]]]:
        """Each term's idf, and for each (term, level) its postings and what one weighs at most. Reads maxima only; at
        most LEVELS rows a term reach the driver."""
        apart = 1 + stats.a / F.col("max_tf") + stats.b * F.col("min_ratio")
        drifted = 1 + F.least(F.lit(1.0), F.col("usual") / stats.avgdl) * (1 / F.col("max_share") - 1)
        maxima = self.blocks.where(F.col("term").isin(list(terms))).groupBy("term", "level").agg(F.sum("n"), F.max(1 / F.greatest(apart, drifted))).collect()
        df: dict[str, int] = {}
        for term, _, n, _ in maxima:
            df[term] = df.get(term, 0) + n
        idf = {t: math.log(1 + (stats.n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        return idf, {(term, at): (n, idf[term] * (rt.K1 + 1) * most) for term, at, n, most in maxima}

    def _postings(self, terms: Sequence[str], idf: dict[str, float], stats: Statistics, levels: set[tuple[str, int]], segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The blocks of these levels, of these (term, generation, segment) if they are given, and their postings
        (id, generation, segment, term, weight)."""
        by_term: dict[str, list[int]] = {}
        for term, at in levels:
            by_term.setdefault(term, []).append(at)
        asked = F.lit(False)
        for term, ats in by_term.items():
            asked |= (F.col("term") == term) & F.col("level").isin(ats)
        blocks = self.blocks.where(F.col("term").isin(list(by_term)) & asked)
        if segments is not None:
            blocks = blocks.join(segments, ["term", "generation", "segment"], "left_semi")
        posting = blocks.select("term", "generation", "segment", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        factor = F.create_map(*[F.lit(v) for t in terms if t in idf for v in (t, idf[t])])[F.col("term")]
        tf, dl = F.col("p.tfs"), F.col("p.dls")
        weight = factor * tf * (rt.K1 + 1) / (tf + rt.K1 * (1 - rt.B + rt.B * dl / stats.avgdl))
        return blocks, posting.select(F.col("p.ids").alias("id"), "generation", "segment", "term", weight.alias("weight"))

    def search(self, terms: Sequence[str], k: int) -> tuple[DataFrame, dict[str, int]]:
        """(id, score, rank), and how many postings the terms have and how many of them were read."""
        terms = list(dict.fromkeys(str(t) for t in terms))
        stats = self.statistics()
        idf, levels = self.plan(terms, stats)
        read = {"postings": sum(n for n, _ in levels.values()), "read": 0}
        if not levels or k < 1:
            return self.spark.createDataFrame([], "id long, score double, rank int"), read
        first, chosen = self._first(terms, k, idf, stats, levels)
        floor = kth_best(first, k)
        out, most = left_out({x: levels[x] for x in levels if x not in chosen}, floor)
        kept = set(levels) - out - chosen
        read["read"] += sum(levels[x][0] for x in kept | chosen)
        parts = [F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"w{i}") for i, t in enumerate(terms)]
        weights = [f"w{i}" for i in range(len(terms))]
        partial = first.unionByName(self._postings(terms, idf, stats, kept)[1]).groupBy("id", "generation", "segment").agg(*parts)
        reach = sum((F.coalesce(F.col(w), F.lit(most.get(t, 0.0))) for w, t in zip(weights, terms, strict=True)), F.lit(0.0))
        partial = written(partial.where(reach >= floor - SLACK))
        if out:
            tails = {t for t, _ in out}
            lacking = F.array_compact(F.array(*[F.when(F.col(w).isNull(), F.lit(t)) for w, t in zip(weights, terms, strict=True) if t in tails]))
            lookups = partial.select("id", "generation", "segment", F.explode(lacking).alias("term"))
            segments = small(lookups.select("term", "generation", "segment").distinct())
            looked, rest = self._postings(terms, idf, stats, out, segments)
            read["read"] += looked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            more = rest.join(small(lookups.select("id").distinct()), "id", "left_semi").groupBy("id").agg(*parts)
            partial = partial.select("id", *weights).unionByName(more).groupBy("id").agg(*[F.max(w).alias(w) for w in weights])
        score = sum((F.coalesce(F.col(w), F.lit(0.0)) for w in weights), F.lit(0.0))
        return rt.top(partial.select("id", score.alias("score")), k), read

    def _first(self, terms: Sequence[str], k: int, idf: dict[str, float], stats: Statistics, levels: dict[tuple[str, int], tuple[int, float]]) -> tuple[DataFrame, set[tuple[str, int]]]:
        """The postings, written, of the levels with the largest bounds: four times k of them or more, if there are."""
        chosen: set[tuple[str, int]] = set()
        for at in sorted(levels, key=lambda x: -levels[x][1]):
            chosen.add(at)
            if sum(levels[x][0] for x in chosen) >= 4 * k:
                break
        return written(self._postings(terms, idf, stats, chosen)[1]), chosen


def kth_best(postings: DataFrame, k: int) -> float:
    """The k-th best sum of weights by id, which k rows reach; minus infinity if there are fewer rows."""
    best = postings.groupBy("id").agg(F.sum("weight").alias("score")).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
    return float(best[1]) if best[0] >= k else float("-inf")


def left_out(levels: dict[tuple[str, int], tuple[int, float]], floor: float) -> tuple[set[tuple[str, int]], dict[str, float]]:
    """Levels that needn't be read to find rows that reach the floor, and what a left out posting of each term weighs at
    most: the sum of these stays below the floor. Whole tails of a term are left out, the longest for its cost first."""
    out: set[tuple[str, int]] = set()
    most: dict[str, float] = {}
    order = {t: sorted((x for x in levels if x[0] == t), key=lambda x: -x[1]) for t, _ in levels}  # lowest level first
    while True:
        best = None
        for term, tail in order.items():
            gain, high = 0, most.get(term, 0.0)
            for at in (x for x in tail if x not in out):
                gain, high = gain + levels[at][0], max(high, levels[at][1])
                if sum(v for t, v in most.items() if t != term) + high >= floor - 2 * SLACK:
                    break
                worth = gain / (high - most.get(term, 0.0) + 1e-12)
                if best is None or worth > best[0]:
                    best = (worth, term, at[1], high)
        if best is None:
            return out, most
        _, term, down_to, high = best
        out |= {x for x in order[term] if x[1] >= down_to}
        most[term] = high
