"""An inverted file of vectors kept in a folder: rows by their nearest centre, grown by appending, searched in a few
cells approximately or in as many as it takes exactly.

`centres/` are the means of spherical k-means over a bounded sample (at most `sample_rows` rows, by hash of the id);
every row is indexed: `cells/generation=<id>/cell=<c>/` holds id, unit vector and cosine to the centre, so that a
search reads the partitions of its cells alone. `generations/` is written last; what a lost job left is not read.

A search sends each query to the cells of its `probes` nearest centres and keeps k rows a query and block of a cell;
blocks are parts of a cell of about `block_rows` rows, dealt by hash, so that no task holds a large cell. Exactly:
a cell whose rows lie within the angle r of its centre holds nothing nearer to a query than its angle to the centre
less r; the cells not read whose bound reaches the query's k-th score are read in a second round. `probe` is the place
of a hit's cell in its query's order, from 0: `calibrated` searches a bounded sample of queries exactly, and gives the
least number of probes that finds the wanted share of their neighbours.

Edge cases: a vector that is null, empty, without a direction, of another length than the centres, or that holds a
null or a number that isn't finite is neither indexed nor searched for; null ids neither; an id that is in the index is left
out of an append; of equal ids in one append, and of equal query ids, the first vector is kept; fewer than k rows give fewer hits; an empty index, or one trained on no vectors, gives none.
Scores are cosines rounded to nine places; ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.retrieval import top_per
from palimpsest.operators.stored import small, written

ROWS = "id long, vector array<double>, near double, cell int, generation string"
CENTRES = "cell int, centre array<double>"
HITS = "query_id long, id long, score double, probe int"


def unit_rows(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, vector): the rows with a direction, scaled to length one."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    known = rows.select(F.col(ident).cast("long").alias(ident), v.alias("vector")).where(F.col(ident).isNotNull() & F.coalesce(finite, F.lit(False)))
    return known.withColumn("length", length).where("length > 0").select(ident, F.transform("vector", lambda x: x / F.col("length")).alias("vector"))


def one_each(rows: DataFrame, ident: str) -> DataFrame:
    copy = F.row_number().over(Window.partitionBy(ident).orderBy("vector"))
    return rows.withColumn("copy", copy).where("copy = 1").select(ident, "vector")


def k_means(x: np.ndarray, cells: int, steps: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centre that loses all of its rows stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(steps):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return np.unique(centres, axis=0)


class VectorIndex:
    """An index in a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, block_rows: int = 50_000, queries_per_block: int = 4096) -> None:
        self.spark, self.path, self.block_rows, self.queries_per_block = spark, path, block_rows, queries_per_block

    def train(self, rows: DataFrame, cells: int, sample_rows: int = 16_384, steps: int = 10) -> None:
        """Learns the centres, of vectors as long as most of the sample's, and writes them: once, before the first append."""
        drawn = unit_rows(rows, "id").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()  # the documented sample
        sizes = [len(r["vector"]) for r in drawn]
        dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
        kept = [r["vector"] for r in drawn if len(r["vector"]) == dim]
        x = np.array(kept, np.float64).reshape(len(kept), dim)
        centres = k_means(x, cells, steps) if len(x) else x
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], CENTRES).write.parquet(f"{self.path}/centres")

    def centres(self) -> np.ndarray:
        """At most `cells` rows, as trained."""
        found = self.spark.read.schema(CENTRES).parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in found], np.float64).reshape(len(found), -1 if found else 0)

    def _generations(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        return [r[0] for r in self.spark.read.schema("generation string").parquet(f"{self.path}/generations").collect()]  # one row an append

    @property
    def rows(self) -> DataFrame:
        whole = self._generations()
        if not whole:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/cells").where(F.col("generation").isin(whole))

    def append(self, rows: DataFrame) -> None:
        """Indexes the rows of rows(id, embedding) whose id the index doesn't have."""
        centres = self.centres()
        if not len(centres):
            return
        generation = uuid.uuid4().hex
        shared = self.spark.sparkContext.broadcast(centres)  # at most `cells` vectors

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cosine = np.array(b["vector"].tolist(), np.float64) @ shared.value.T
                    cell = cosine.argmax(axis=1)
                    yield pd.DataFrame({"id": b["id"], "vector": b["vector"], "near": cosine[np.arange(len(b)), cell], "cell": cell.astype(np.int32)})

        fresh = unit_rows(rows, "id").where(F.size("vector") == centres.shape[1]).join(self.rows.select("id"), "id", "left_anti")
        placed = written(one_each(fresh, "id").mapInPandas(nearest, "id long, vector array<double>, near double, cell int"))
        dealt = placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-placed.count() // (self.block_rows * len(centres)))))))
        dealt.write.partitionBy("cell").parquet(f"{self.path}/cells/generation={generation}")
        self.spark.createDataFrame([(generation,)], "generation string").write.mode("append").parquet(f"{self.path}/generations")

    def _sizes(self) -> list[tuple[int, int, float]]:
        """(cell, rows, least cosine to the centre), at most one row a cell."""
        return [tuple(r) for r in self.rows.groupBy("cell").agg(F.count("*"), F.min("near")).orderBy("cell").collect()]

    def _meet(self, asked: DataFrame, sizes: list[tuple[int, int, float]], k: int) -> DataFrame:
        """asked(query_id, vector, cell, probe) against the rows of their cells: HITS, at most k a query and block."""
        read = [r[0] for r in asked.select("cell").distinct().collect()]  # at most one row a cell
        parts = {cell: max(1, -(-n // self.block_rows)) for cell, n, _ in sizes if cell in read}
        counts = {r["cell"]: -(-r["n"] // self.queries_per_block) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        known = small(self.spark.createDataFrame([(c, parts[c], int(counts[c])) for c in sorted(parts)], "cell int, parts int, shares int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = self.rows.where(F.col("cell").isin(sorted(parts))).select("id", F.col("vector").alias("v"), "cell").join(known, "cell")
        data = data.select("cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), every("shares").alias("share"))
        queries = asked.join(known, "cell").select("cell", "query_id", "vector", "probe", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("share"), every("parts").alias("part"))

        def multiply(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "score": [], "probe": []}).astype({"query_id": "int64", "id": "int64", "score": "float64", "probe": "int32"})]
            ids = p["id"].to_numpy()
            matrix = np.array(p["v"].tolist(), np.float64)
            for at in range(0, len(q) if len(ids) else 0, 64):
                some = q.iloc[at : at + 64]
                scores = np.round(np.array(some["vector"].tolist(), np.float64) @ matrix.T, 9)
                for query, probe, row in zip(some["query_id"], some["probe"], scores, strict=True):
                    best = np.lexsort((ids, -row))[:k]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[best], "score": row[best], "probe": np.int32(probe)}))
            return pd.concat(out)

        key = ["cell", "part", "share"]
        return queries.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(multiply, HITS)

    def _order(self, queries: DataFrame, centres: np.ndarray, sizes: list[tuple[int, int, float]], probes: int, rest: bool) -> DataFrame:
        """(query_id, vector, cell, probe): each query's `probes` nearest cells that have rows; or the rest of them, those
        whose bound reaches the query's floor."""
        cells = np.array([s[0] for s in sizes])
        radius = np.arccos(np.clip([s[2] for s in sizes], -1, 1))
        shared = self.spark.sparkContext.broadcast((centres[cells], cells, radius))  # at most `cells` rows

        def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near, cells, radius = shared.value
            for b in batches:
                for _, r in b.iterrows():
                    cosine = near @ np.asarray(r["vector"])
                    place = np.argsort(-cosine, kind="stable")
                    at = np.arange(len(place))
                    if rest:
                        reach = np.cos(np.maximum(np.arccos(np.clip(cosine, -1, 1)) - radius, 0))[place]
                        keep = (at >= probes) & (reach >= r["floor"] - 1e-8)
                    else:
                        keep = at < probes
                    if keep.any():
                        yield pd.DataFrame({"query_id": r["query_id"], "vector": [r["vector"]] * int(keep.sum()), "cell": cells[place[keep]].astype(np.int32), "probe": at[keep].astype(np.int32)})

        return queries.mapInPandas(order, "query_id long, vector array<double>, cell int, probe int")

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
        """(query_id, id, score, probe, rank), the k best of each of queries(query_id, embedding)."""
        centres, sizes = self.centres(), self._sizes()
        if not sizes:
            return self.spark.createDataFrame([], HITS + ", rank int")
        asked = written(one_each(unit_rows(queries, "query_id").where(F.size("vector") == centres.shape[1]), "query_id"))
        found = written(self._meet(written(self._order(asked, centres, sizes, probes, False)), sizes, k))
        if exact:
            best = top_per(found, ["query_id"], k, F.desc("score"), F.asc("id"))
            floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            known = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
            found = found.unionByName(self._meet(written(self._order(known, centres, sizes, probes, True)), sizes, k))
        return top_per(found, ["query_id"], k, F.desc("score"), F.asc("id"))

    def calibrated(self, queries: DataFrame, k: int, least: float = 0.9, most_queries: int = 512) -> int:
        """The least number of probes that finds the share `least` of the k nearest rows of a sample of the queries."""
        sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most_queries)
        probes = max(1, len(self.centres()) // 8)
        places = self.search(sample, k, probes, exact=True).groupBy("probe").count().orderBy("probe").collect()  # at most one row a cell
        total, seen = sum(r["count"] for r in places), 0
        for r in places:
            seen += r["count"]
            if seen >= least * total:
                return r["probe"] + 1
        return 1

    def share_read(self, queries: DataFrame, probes: int) -> float:
        """The share of all pairs of a query and a row that a search with so many probes compares."""
        centres, sizes = self.centres(), self._sizes()
        asked = unit_rows(queries, "query_id").where(F.size("vector") == (centres.shape[1] if len(centres) else 0))
        n, count = sum(s[1] for s in sizes), asked.count()
        if not n or not count:
            return 0.0
        known = F.create_map(*[F.lit(x) for cell, rows, _ in sizes for x in (cell, rows)])[F.col("cell")]
        return self._order(asked, centres, sizes, probes, False).agg(F.sum(known)).first()[0] / (n * count)
