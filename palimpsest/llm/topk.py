"""Exact top-k search by inner product with dual cover trees.

Vectors are turned into whole numbers, floor(scale * x), and dealt to blocks: the top level of a cover
tree, whose centres are a farthest-first net of a bounded sample, takes every row to its nearest
centre; centre and covering radius of each block are kept, and a block with more than `data_rows` rows
is split by a hash. The search then has two rounds:

1. every query meets the block that it lies in, which gives it a first k-th score;
2. it goes on to those other blocks alone whose bound, q.c + |q| r, reaches that score, and carries
   it along.

Inside a block, cover trees over both sides are searched together. They are built on the leading coordinates: three
quarters of the directions, those in which the block spreads most. A node has a centre, a covering radius and the
length of the longest remainder below it; nodes are divided down to leaves of a few rows, whose children are the single
rows, with radius 0. A pair of nodes with centres q and p, radii rq and rp, remainders sq and sp holds no inner product
above q.p + rq |p| + rp |q| + rq rp + sq sp; it is pruned if that is below the worst k-th score of the queries below
the query node. A query node hands on the data nodes that it couldn't prune to its children, which go on from there; at
a query leaf the data leaves come in the order of their bounds, until one can be pruned, and a pair of a query and a
row is pruned like any other pair of nodes. Only what reaches the k-th score is compared in full, in whole numbers. So
the result is exact; ties go to the smaller vec_id. Where distances concentrate, as between random vectors of 64
dimensions, hardly any ball of several rows is small enough to be pruned, and most pruning is that of single rows; every
data row is then written once for each `query_rows` queries. `Search.pruned` counts the pairs of nodes pruned above the
single rows, `Search.compared` the full comparisons.

Edge cases: vectors that are null or hold a null or a number that isn't finite take no part; only
vectors of equal length are compared; rows that share the query's vec_id are its own and no candidates;
query rows with one vec_id and different vectors each search, and their results share one ranking;
repeated rows are candidates each; an empty vector scores 0 with other empty ones; an empty table
gives an empty result; other columns are ignored. Scores beyond a long are cut to its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, narrow

#: Rows of a data leaf and of a query leaf (a query group is pruned by its worst member), children of a node, columns bounded at a time.
LEAF, QUERY_LEAF, FAN, CHUNK = 32, 4, 32, 2048
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rest: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


class Balls:
    """A data tree's nodes, level by level, as arrays: what a query node is bounded against at once."""

    def __init__(self, root: Node) -> None:
        self.nodes, at = [root], 0
        first, count = [], []
        while at < len(self.nodes):
            first.append(len(self.nodes))
            count.append(len(self.nodes[at].children))
            self.nodes += self.nodes[at].children
            at += 1
        self.first, self.count = np.array(first), np.array(count)
        self.rows = np.array([len(n.rows) for n in self.nodes])
        self.centre = np.array([n.centre for n in self.nodes])
        self.radius, self.rest = np.array([n.radius for n in self.nodes]), np.array([n.rest for n in self.nodes])
        self.length = np.sqrt((self.centre**2).sum(axis=1))

    def bounds(self, q: Node, which: np.ndarray) -> np.ndarray:
        """Above any inner product of a query below q and a row below each node."""
        length = float(np.sqrt(q.centre @ q.centre))
        return self.centre[which] @ q.centre + q.radius * self.length[which] + self.radius[which] * (length + q.radius) + q.rest * self.rest[which]

    def children(self, which: np.ndarray) -> np.ndarray:
        n = self.count[which]
        return np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def away(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def net(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first net of at most `most` rows: their places, and for each row the nearest one's place in the net."""
    chosen, nearest = [0], np.zeros(len(x), np.int64)
    distance = away(x, x[0])
    while len(chosen) < most and distance.max() > 0:
        pick = int(distance.argmax())
        new = away(x, x[pick])
        nearer = new < distance
        nearest[nearer], distance[nearer] = len(chosen), new[nearer]
        chosen.append(pick)
    return np.array(chosen), nearest


def cover_tree(x: np.ndarray, rest: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None) -> Node:
    """Nested covers: the children of a node are balls around a farthest-first net of it, down to leaves of at most `leaf`
    rows, or of rows that lie at one place. rest are the lengths that x leaves out."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows].mean(axis=0)
    node = Node(centre, float(away(x[rows], centre).max()), float(rest[rows].max()), rows)
    if len(rows) > leaf and node.radius > 0:
        _, nearest = net(x[rows], min(FAN, max(2, -(-2 * len(rows) // leaf))))
        if nearest.max() > 0:
            node.children = [cover_tree(x, rest, leaf, rows[nearest == i]) for i in range(nearest.max() + 1)]
    return node


class Search:
    """The k best of each query so far, and the walk over node pairs that betters them. `floor` are k-th
    scores known before; compared counts full comparisons by query, pruned the pairs of nodes that were."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.q_ids, self.q, self.p_ids, self.p, self.k = q_ids, q, p_ids, p, k
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(q.shape[1], 1)
        self.whole = largest < 2**53  # then products of floats are exact
        self.qf, self.pf = q.astype(np.float64), p.astype(np.float64)
        self.slack = 1 + largest * 1e-12
        self.best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        self.worst = np.full(len(q_ids), -np.inf) if floor is None else floor.astype(np.float64)
        self.compared, self.pruned = np.zeros(len(q_ids), np.int64), 0
        self._rotate()

    def _rotate(self) -> None:
        """Coordinates along the data's directions of most spread, and the lengths of what is left out."""
        d = self.pf.shape[1]
        self.leading = -(-3 * d // 4)
        basis = np.linalg.eigh(self.pf.T @ self.pf / max(len(self.pf), 1))[1][:, ::-1] if d and len(self.pf) else np.eye(d)
        rest = lambda x: np.sqrt(np.maximum((x[:, self.leading :] ** 2).sum(axis=1), 0))
        q, p = self.qf @ basis, self.pf @ basis
        self.q_lead, self.q_rest, self.p_lead, self.p_rest = q[:, : self.leading], rest(q), p[:, : self.leading], rest(p)

    def scores(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Products of rows[i] and cols[i]."""
        if self.whole:
            return np.einsum("ij,ij->i", self.qf[rows], self.pf[cols])
        exact = (self.q[rows].astype(object) * self.p[cols].astype(object)).sum(axis=1)
        return np.clip(exact, *LONG)

    def offer(self, row: int, cols: np.ndarray, scores: np.ndarray) -> None:
        """Candidates for a query, in the order of their ids."""
        first = np.argsort(-scores, kind="stable")[: self.k]
        merged = sorted([*self.best[row], *((-int(scores[c]), int(self.p_ids[cols[c]])) for c in first)])[: self.k]
        self.best[row] = merged
        if len(merged) == self.k:
            self.worst[row] = max(self.worst[row], -merged[-1][0])

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """The lowest level: queries `rows` and vectors `cols`, single rows of radius 0."""
        part = np.sort(cols)  # in the order of their ids, as the vectors are
        bound = self.q_lead[rows] @ self.p_lead[part].T + np.outer(self.q_rest[rows], self.p_rest[part]) + self.slack
        i, j = np.nonzero(bound >= self.worst[rows][:, None])
        other = self.q_ids[rows[i]] != self.p_ids[part[j]]
        i, j = i[other], j[other]
        found = self.scores(rows[i], part[j])
        self.compared += np.bincount(rows[i], minlength=len(self.compared))
        kept = np.flatnonzero(found >= self.worst[rows[i]])
        ends = np.searchsorted(i[kept], np.arange(len(rows) + 1))
        for r in np.unique(i[kept]):
            mine = kept[ends[r] : ends[r + 1]]
            self.offer(int(rows[r]), part[j[mine]], found[mine])

    def visit(self, a: Node, which: np.ndarray) -> None:
        """a against data nodes: what isn't pruned is divided once where a has children, and to the leaves where it has none."""
        leaves, reach = [], []
        while len(which):
            bounds = self.balls.bounds(a, which) + self.slack
            kept = bounds >= self.worst[a.rows].min()
            self.pruned += len(which) - int(kept.sum())
            inner = self.balls.count[which] > 0
            leaves.append(which[kept & ~inner])
            reach.append(bounds[kept & ~inner])
            which = self.balls.children(which[kept & inner])
            if a.children:
                break
        ends = np.concatenate(leaves)
        if a.children:
            onward = np.concatenate([ends, which])
            for child in a.children if len(onward) else ():
                self.visit(child, onward)
        elif len(ends):
            bounds = np.concatenate(reach)
            order = np.argsort(-bounds, kind="stable")
            last = np.cumsum(self.balls.rows[ends[order]])
            at, step = 0, 2 * LEAF  # a small first step: it gives the queries their first k-th scores
            while at < len(order) and bounds[order[at]] >= self.worst[a.rows].min():
                upto = max(at + 1, int(np.searchsorted(last, (last[at - 1] if at else 0) + step, "right")))
                self.compare(a.rows, np.concatenate([self.balls.nodes[i].rows for i in ends[order[at:upto]]]))
                at, step = upto, min(2 * step, CHUNK)
            self.pruned += len(order) - at

    def run(self) -> None:
        if not len(self.q_ids) or not len(self.p_ids):
            return
        self.balls = Balls(cover_tree(self.p_lead, self.p_rest))
        self.visit(cover_tree(self.q_lead, self.q_rest, QUERY_LEAF), np.array([0]))

    def rows(self) -> Iterator[tuple[int, int | None, int | None, int | None]]:
        """(query, vec_id, score, None) of what was found, and (query, None, None, compared) for each query."""
        for q, found, compared in zip(self.q_ids, self.best, self.compared, strict=True):
            yield int(q), None, None, int(compared)
            for negative, vec_id in found:
                yield int(q), vec_id, -negative, None


FOUND = "query_id long, vec_id long, score long, compared long"


def vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part: whole numbers, floor(scale * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("v"))


def matrix(values: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), dim)


def centres(whole: DataFrame, n: int, data_rows: int, most: int, sample_rows: int) -> dict[int, np.ndarray]:
    """By length of the vectors, a net of a sample of at most `sample_rows` rows."""
    wanted = min(most, -(-n // data_rows))
    share = min(1.0, sample_rows / max(n, 1))
    drawn = whole.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(sample_rows).collect() if wanted > 1 else []
    by_dim: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: r["vec_id"]):
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, rows in by_dim.items():
        x = np.array(rows, np.float64).reshape(len(rows), dim)
        out[dim] = x[net(x, max(1, wanted))[0]]
    return out


def in_blocks(whole: DataFrame, table: dict[int, np.ndarray]) -> DataFrame:
    """(dim, block, vec_id, v as bytes, distance from the block's centre) of every row."""
    shared = whole.sparkSession.sparkContext.broadcast(table)  # a net: at most max_centres vectors of each length in a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len)
            for dim, rows in b.groupby(size):
                x = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), int(dim))
                xf, c = x.astype(np.float64), shared.value.get(int(dim), np.zeros((1, int(dim))))
                block = ((c**2).sum(axis=1) - 2 * xf @ c.T).argmin(axis=1)
                yield pd.DataFrame({"dim": int(dim), "block": block, "vec_id": rows["vec_id"].to_numpy(), "v": [v.tobytes() for v in x], "away": away(xf, c[block])})

    return whole.mapInPandas(run, "dim int, block int, vec_id long, v binary, away double")


def meet(k: int):
    def run(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score", "compared"]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=columns).astype("Int64")
        dim = int(key[0])
        p = p.sort_values("vec_id", kind="stable")
        search = Search(q["vec_id"].to_numpy(), matrix(q["v"], dim), p["vec_id"].to_numpy(), matrix(p["v"], dim), k, q["floor"].to_numpy())
        search.run()
        found = list(search.rows())
        return pd.DataFrame({c: pd.array([r[i] for r in found], dtype="Int64") for i, c in enumerate(columns)})  # whole numbers beside nulls

    return run


def routes(queries: DataFrame, blocks: list[tuple[int, int, float]], table: dict[int, np.ndarray]) -> DataFrame:
    """(dim, block, vec_id, v, floor): each query with the blocks, but its own, that may hold a better score."""
    shared = queries.sparkSession.sparkContext.broadcast((blocks, table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, table = shared.value
        for b in batches:
            for dim, rows in b.groupby("dim"):
                mine = [(block, radius) for d, block, radius in blocks if d == dim]
                ids, radius = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
                c = table.get(int(dim), np.zeros((1, int(dim))))[ids]
                q = matrix(rows["v"], int(dim)).astype(np.float64)
                length = np.sqrt((q**2).sum(axis=1))
                bound = q @ c.T + np.outer(length, radius)
                slack = 1 + 1e-9 * (np.abs(bound) + length[:, None])
                i, j = np.nonzero((bound + slack >= rows["floor"].to_numpy()[:, None]) & (ids[None, :] != rows["block"].to_numpy()[:, None]))
                for at in range(0, len(i), 1 << 14):  # a query may go to many blocks: its vector is copied for a part of them at a time
                    own = rows.iloc[i[at : at + (1 << 14)]]
                    yield pd.DataFrame({"dim": int(dim), "block": ids[j[at : at + (1 << 14)]], "vec_id": own["vec_id"].to_numpy(), "v": own["v"].to_numpy(), "floor": own["floor"].to_numpy()})

    return queries.mapInPandas(run, "dim int, block int, vec_id long, v binary, floor double")


def matches(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, data_rows: int = 20000, query_rows: int = 20000, max_centres: int = 1024, sample_rows: int = 16384) -> DataFrame:
    """What the searches of single blocks found: (query_id, vec_id, score), at most k of a query and block, and
    for each of them a row (query_id, compared): the query's full comparisons there."""
    whole = materialize(vectors(embeddings, scale))
    table = centres(whole, whole.count(), data_rows, max_centres, sample_rows)
    rows = materialize(in_blocks(whole, table))
    sizes = rows.groupBy("dim", "block").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / data_rows).cast("int")))
    few = narrow(sizes.select("dim", "block", "parts"), 100_000)
    data = rows.select("dim", "block", "vec_id", "v").join(few, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    is_query = F.col("vec_id") % every == 0
    # round 1: a query and its own part of its block
    key = ["dim", "block", "part"]
    first = materialize(data.where(is_query).dropDuplicates([*key, "vec_id", "v"]).withColumn("floor", F.lit(float("-inf"))))
    near = materialize(first.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(meet(k), FOUND))
    # round 2: the other parts of its block, and the blocks whose bound reaches what it has
    worst = near.where("vec_id is not null").groupBy("query_id").agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), False)[k - 1]).alias("floor"))
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))
    known = first.drop("floor").join(worst, first["vec_id"] == worst["query_id"], "left").select(*key, "parts", "vec_id", "v", floor.alias("floor"))
    known = materialize(known)
    blocks = [(r["dim"], r["block"], r["radius"]) for r in sizes.collect()]  # at most max_centres of each length in the sample, one of each other
    siblings = known.where("parts > 1").select("dim", "block", "vec_id", "v", "floor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("part").alias("own")).where("part <> own").drop("own")
    others = routes(known, blocks, table).join(few, ["dim", "block"]).select("dim", "block", "vec_id", "v", "floor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = materialize(siblings.unionByName(others))
    shares = materialize(sent.groupBy(*key).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares")))
    shares = narrow(shares, 100_000)
    asked = sent.join(shares, key).withColumn("share", F.pmod(F.xxhash64("vec_id", "v"), F.col("shares")).cast("int"))
    spread = data.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*key, "share", "vec_id", "v")
    far = asked.select(*key, "share", "vec_id", "v", "floor").groupBy(*key, "share").cogroup(spread.groupBy(*key, "share")).applyInPandas(meet(k), FOUND)
    return near.unionByName(far)


def top_k(embeddings: DataFrame, k: int = 5, **params) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query: a row whose vec_id is divisible by `every`."""
    found = matches(embeddings, k=k, **params).where("vec_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole p ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
