"""Entity graph and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.stored import written


def normalised_name(name: Column) -> Column:
    """Lower case, accents of Latin letters folded, other marks as spaces. Fixed folding, not full decomposition."""
    folded = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "), " +", " "))


def by_name_or_alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions(mention), entities(entity, name_norm, aliases_norm): name matches before alias matches, two equi-joins."""
    by_name = mentions.join(entities.select("entity", F.col("name_norm").alias("mention")), "mention").withColumn("via", F.lit(0))
    alias = entities.select("entity", F.explode("aliases_norm").alias("mention"))
    both = by_name.unionByName(mentions.join(alias, "mention").withColumn("via", F.lit(1)))
    first = Window.partitionBy("mention").orderBy("via", "entity")
    return both.withColumn("k", F.row_number().over(first)).where("k = 1").select("mention", "entity", F.when(F.col("via") == 0, "name").otherwise("alias").alias("via"))


def prefix_matches(misses: DataFrame, entities: DataFrame, least: int = 4, ratio: float = 0.5) -> DataFrame:
    """A missed mention and an entity name one of which starts the other, if there is just one: joined on the
    first `least` letters, never on all pairs."""
    left = misses.where(F.length("mention") >= least).withColumn("p", F.substring("mention", 1, least))
    right = entities.where(F.length("name_norm") >= least).withColumn("p", F.substring("name_norm", 1, least))
    a, b = F.length("mention"), F.length("name_norm")
    met = left.join(right, "p").where((F.startswith("mention", "name_norm") | F.startswith("name_norm", "mention")) & (F.least(a, b) / F.greatest(a, b) >= ratio))
    return met.groupBy("mention").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).where("n = 1").drop("n")


def prefix_groups(edges: DataFrame, least: int, jaccard: float, part_ids: int) -> DataFrame:
    """(group, entity, x, y, part, id, n, tail): for each of the rarest entities of an id, which any id that is alike enough
    must share with it, the id's entities from this one on, in the order of rarity. The group of an entity that
    more than `part_ids` ids begin with is dealt to parts, every two of which meet: x <= y, part one of them."""
    known = edges.join(edges.groupBy("entity").agg(F.count("*").alias("f")), "entity")
    sets = known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "entity"))), lambda e: e["entity"]).alias("all")).withColumn("n", F.size("all"))
    # two sets that share s have one in common among all but the last s - 1 of either
    must = F.greatest(F.ceil(F.lit(jaccard) * F.col("n")), F.lit(least), F.lit(1))
    sets = written(sets.withColumn("must", must.cast("int")).where("n >= must").select("id", "n", "must", "all"))
    begins = lambda df, *more: df.select("id", "n", *more, F.posexplode(F.slice("all", F.lit(1), F.col("n") - F.col("must") + 1)).alias("at", "entity"))
    sizes = begins(sets).groupBy("entity").agg(F.ceil(F.count("*") / F.lit(part_ids)).cast("int").alias("parts"))
    tails = begins(sets, "all").select("id", "n", "entity", F.slice("all", F.col("at") + 1, F.col("n")).alias("tail"))
    placed = tails.join(sizes, "entity").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("entity", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "n", "tail")


def alike_in_group(part: np.ndarray, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, entities: np.ndarray, x: int, y: int, least: int, jaccard: float, at_once: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared) of pairs a < b between parts x and y of one group: rows with `sizes` entities each, end to end."""
    row = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(entities, kind="stable")
    row, entities = row[order], entities[order]
    end = np.searchsorted(entities, entities, "right")
    later = end - np.arange(len(entities)) - 1  # each entity's rows after this one
    out = [], [], []
    step = max(1, at_once // max(len(ids), 1))
    for lo in range(0, len(ids), step):
        mine = np.flatnonzero((row >= lo) & (row < lo + step))
        counts = np.zeros((min(step, len(ids) - lo)) * len(ids), np.int64)
        cuts = np.searchsorted(np.cumsum(later[mine]), np.arange(at_once, later[mine].sum() + at_once, at_once)) + 1
        start = 0
        for stop in np.minimum(cuts, len(mine)):
            some = mine[start:stop]
            k = later[some]
            places = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(some + 1, k)
            counts += np.bincount((np.repeat(row[some], k) - lo) * len(ids) + row[places], minlength=len(counts))
            start = stop
        i, j = np.divmod(np.flatnonzero(counts >= least), len(ids))
        shared = counts.reshape(-1, len(ids))[i, j]
        i += lo
        keep = (shared / (n[i] + n[j] - shared) > jaccard) & (ids[i] != ids[j])
        keep &= (part[i] != part[j]) if x != y else True
        for parts, values in zip(out, (np.minimum(ids[i], ids[j])[keep], np.maximum(ids[i], ids[j])[keep], shared[keep]), strict=True):
            parts.append(values)
    return tuple(np.concatenate([np.zeros(0, np.int64), *parts]) for parts in out)


def shared_pairs(edges: DataFrame, least: int = 2, jaccard: float = 0.3, block_ids: int = 1500, per_call: int = 20_000) -> DataFrame:
    """edges(entity, id), whole numbers: (a, b, shared, jaccard) of ids a < b that share `least` entities or more and
    whose sets are more alike than `jaccard`. Ids meet where one of the rarest entities of both is the same, and
    what they share is counted inside the task, so that no row is written for a pair below the thresholds. The first
    such entity counts all that two ids share, later ones less: the most counts. An id is sent once for each of
    its rarest entities, whatever the table's size; a group of a frequent one is dealt to parts of `block_ids`."""
    least = max(least, 1)
    edges = written(edges.where(F.col("entity").isNotNull() & F.col("id").isNotNull()).select(F.col("entity").cast("long").alias("entity"), F.col("id").cast("long").alias("id")).distinct())
    groups = prefix_groups(edges, least, jaccard, block_ids)
    calls = max(32, -(-edges.count() // per_call))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "shared": [], "jaccard": []}).astype({"a": "int64", "b": "int64", "shared": "int64", "jaccard": "float64"})]
        for (_, x, y), rows in pdf.groupby(["entity", "x", "y"], sort=False):
            if len(rows) < 2:
                continue
            sizes = rows["tail"].map(len).to_numpy()
            ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
            a, b, shared = alike_in_group(rows["part"].to_numpy(), ids, n, sizes, np.concatenate(rows["tail"].to_numpy()), x, y, least, jaccard)
            if len(a):
                order = np.argsort(ids)
                size = lambda of, order=order, ids=ids, n=n: n[order][np.searchsorted(ids[order], of)]
                out.append(pd.DataFrame({"a": a, "b": b, "shared": shared, "jaccard": shared / (size(a) + size(b) - shared)}))
        return pd.concat(out)

    called = groups.withColumn("call", F.pmod(F.xxhash64("entity", "x", "y"), F.lit(calls)))
    found = called.groupBy("call").applyInPandas(count, "a long, b long, shared long, jaccard double")
    return found.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard"))


def clusters(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, cluster): connected components by least label with shortcutting; ends when nothing changes."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("cluster")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        jump = label.select(F.col("id").alias("cluster"), F.col("cluster").alias("far"))
        new = label.join(near, "id", "left").join(jump, "cluster", "left").select("id", F.least("cluster", "near", "far").alias("cluster"), F.col("cluster").alias("old"))
        new = written(new)
        if new.where("cluster <> old").isEmpty():
            return new.select("id", "cluster")
        label = new.select("id", "cluster")
    raise ValueError("clusters not settled")


def fingerprint(ids: Column) -> Column:
    """The first 16 hexadecimal digits of the sorted ids' hash: the same whatever the order."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ","), 256), 1, 16)


def merged_entities(rows: DataFrame, by: list[str]) -> DataFrame:
    """Entity upsert: alias union, longest description, highest confidence, first and last seen."""
    return rows.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.max("confidence").alias("confidence"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
    )
