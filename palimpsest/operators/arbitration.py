"""Write arbitration: what to do with an incoming record, given the tenant's recent ones.

Candidates are at most `k` per incoming record; the decision is one ladder of bands over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vec
from palimpsest.operators.stored import written

# Thresholds and windows.
SKIP, SKIP_HOURS, MERGE, MERGE_HOURS, CANDIDATES, MERGED_CHARS = 0.95, 24, 0.85, 72, 5, 1200
STATES = (("enabled", "disabled"), ("on", "off"), ("open", "closed"), ("active", "inactive"))


def nearest(incoming: DataFrame, store: DataFrame, hours: int = MERGE_HOURS, k: int = CANDIDATES, least: float = -1.0, block: int = 4000, at_once: int = 20_000) -> DataFrame:
    """(new_id, old_id, age_hours, similarity, rank): for each of incoming(id, user_id, embedding, created_at) its most
    similar stored rows of the last hours; ids are unique, texts take no part. Rows meet by tenant and time
    bucket, a bucket's rows are dealt to blocks, and two blocks are one product of matrices inside a task, of
    which k rows a new id leave it. The product only proposes: what may be among the k is summed again in order."""
    bucket = F.floor(F.col("at") / (hours * 3600))
    usable = lambda rows: rows.where("id is not null and user_id is not null and embedding is not null and created_at is not null").select(
        "user_id", "id", F.col("embedding").cast("array<double>").alias("v"), F.unix_seconds("created_at").alias("at"))
    scaled = lambda rows: usable(rows).withColumn("norm", F.coalesce(vec.norm(F.col("v")), F.lit(0.0)))
    new = scaled(incoming).withColumn("b", F.explode(F.array(bucket, bucket - 1)))
    old = scaled(store).withColumn("b", bucket)
    parts = lambda rows, name: rows.groupBy("user_id", "b").agg(F.count("*").alias(f"n_{name}"), F.ceil(F.count("*") / F.lit(block)).alias(name))
    sizes = written(parts(new, "news").join(parts(old, "olds"), ["user_id", "b"]))
    total = sizes.agg(F.sum(F.col("news") * F.col("olds")).alias("cells"), F.sum(F.col("n_news") * F.col("olds") + F.col("n_olds") * F.col("news")).alias("rows")).first()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    place = ["user_id", "b", "i", "j"]
    left = new.join(sizes, ["user_id", "b"]).select("*", own("news").alias("i"), every("olds").alias("j"), F.lit(True).alias("new"))
    right = old.join(sizes, ["user_id", "b"]).select("*", own("olds").alias("j"), every("news").alias("i"), F.lit(False).alias("new"))
    # a bucket may have few rows: cells travel together, about at_once rows in one call
    dealt = left.select(*place, "new", "id", "v", "at", "norm").unionByName(right.select(*place, "new", "id", "v", "at", "norm"))
    calls = max(1, min(total["cells"] or 1, max(32, -(-(total["rows"] or 0) // at_once))))
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64(*place), F.lit(calls)))
    kinds = {f.name: f.dataType.simpleString() for f in incoming.schema}, {f.name: f.dataType.simpleString() for f in store.schema}

    def meet(pdf):
        import pandas as pd

        out = [_block_nearest(cell[cell["new"]], cell[~cell["new"]], hours, k, least) for _, cell in pdf.groupby(place)]
        return pd.concat(out) if out else pd.DataFrame({"new_id": [], "old_id": [], "age_hours": [], "similarity": []})

    found = dealt.groupBy("call").applyInPandas(meet, f"new_id {kinds[0]['id']}, old_id {kinds[1]['id']}, age_hours double, similarity double")
    best = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block_nearest(new, old, hours: int, k: int, least: float, at_once: int = 4_000_000):
    """The k most similar rows of old for each row of new, ties to the smaller id."""
    import numpy as np
    import pandas as pd

    new_ids, old_ids = new["id"].to_numpy(), old["id"].to_numpy()
    out = [pd.DataFrame({"new_id": new_ids[:0], "old_id": old_ids[:0], "age_hours": np.empty(0), "similarity": np.empty(0)})]
    if not len(new) or not len(old):
        return out[0]
    place = np.unique(old_ids, return_inverse=True)[1]  # ids of any type in their order
    sizes = old["v"].map(len).to_numpy()
    old_at, old_norm = old["at"].to_numpy(), old["norm"].to_numpy()
    for size, part in new.groupby(new["v"].map(len)):
        same = np.flatnonzero(sizes == size)
        b = np.array(old["v"].iloc[same].tolist(), np.float64).reshape(len(same), size)
        column = np.full(len(old), -1)
        column[same] = np.arange(len(same))
        step = max(1, at_once // len(old))
        for lo in range(0, len(part), step):
            some = part.iloc[lo : lo + step]
            a = np.array(some["v"].tolist(), np.float64).reshape(len(some), size)
            norm = some["norm"].to_numpy()
            age = (some["at"].to_numpy()[:, None] - old_at[None, :]) / 3600.0
            with np.errstate(all="ignore"):
                scale = norm[:, None] * old_norm[None, :]
                close = np.zeros((len(some), len(old)))
                if size and len(same):
                    close[:, same] = a @ b.T / scale[:, same]
                usable = ((scale > 0) | np.isnan(scale)) & (column >= 0)[None, :] & (size > 0)
            close = np.where(usable, np.where(np.isfinite(close), close, np.inf), 0.0)
            close[(age < 0) | (age > hours) | (some["id"].to_numpy()[:, None] == old_ids[None, :])] = -np.inf
            floor = np.partition(close, len(old) - k, axis=1)[:, len(old) - k] if len(old) > k else np.full(len(some), -np.inf)
            i, j = np.nonzero((close > -np.inf) & (close >= np.maximum(floor, least)[:, None] - 1e-9))
            total = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for d in range(size if len(same) else 0):
                    total += a[i, d] * b[column[j], d]
                total = np.where(usable[i, j], total / scale[i, j], 0.0)
            kept = (total >= least) | np.isnan(total)
            i, j, total = i[kept], j[kept], total[kept]
            order = np.lexsort((place[j], np.where(np.isnan(total), -np.inf, -total), i))
            i, j, total = i[order], j[order], total[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            i, j, total = i[first], j[first], total[first]
            out.append(pd.DataFrame({"new_id": some["id"].to_numpy()[i], "old_id": old_ids[j], "age_hours": age[i, j], "similarity": total}))
    return pd.concat(out)


def candidates(incoming: DataFrame, store: DataFrame, hours: int = MERGE_HOURS, k: int = CANDIDATES, least: float = -1.0) -> DataFrame:
    """nearest() with the texts of both sides: new_text, old_text."""
    found = nearest(incoming, store, hours, k, least)
    return found.join(incoming.select(F.col("id").alias("new_id"), F.col("text").alias("new_text")), "new_id").join(store.select(F.col("id").alias("old_id"), F.col("text").alias("old_text")), "old_id")


def opposing(a: Column, b: Column) -> Column:
    """One text holds a state word and the other its opposite."""
    out = F.lit(False)
    for x, y in STATES:
        word = lambda t, w: F.array_contains(tx.tokens(t), w)
        out = out | (word(a, x) & word(b, y)) | (word(a, y) & word(b, x))
    return out


def supersedes(old: Column, new: Column) -> Column:
    """Same statement key, and an opposite state or values neither of which holds the other."""
    side = lambda t: F.struct(tx.statement_key(t).alias("k"), tx.statement_value(t).alias("v"))

    def compare(o: Column, n: Column) -> Column:
        differ = (o["v"] != "") & (n["v"] != "") & (o["v"] != n["v"]) & ~F.contains(o["v"], n["v"]) & ~F.contains(n["v"], o["v"])
        return (o["k"] != "") & (o["k"] == n["k"]) & (opposing(old, new) | differ)

    return tx.let(side(old), lambda o: tx.let(side(new), lambda n: compare(o, n)))


def additive(old: Column, new: Column, least: int = 3, share: float = 0.40) -> Column:
    """The new text adds three tokens or more, two fifths of its own."""
    novel = F.size(F.array_except(tx.tokens(new), tx.tokens(old)))
    return (novel >= least) & (novel / F.greatest(F.size(F.array_distinct(tx.tokens(new))), F.lit(1)) >= share)


def band(same: Column, similarity: Column, age: Column, corrects: Column, contained: Column, conflict: Column, merge: float = MERGE) -> Column:
    """The ladder: exact copy - skip; correction - supersede; near copy - skip; similar - create if the
    anchors conflict, skip if contained, else merge; otherwise create."""
    similar = (similarity >= merge) & (age <= MERGE_HOURS)
    return (
        F.when(same & (age <= SKIP_HOURS), "1_skip_exact")
        .when(similar & corrects & ~conflict, "2_supersede")
        .when((similarity >= SKIP) & (age <= SKIP_HOURS) & ~conflict, "3_skip_near")
        .when(similar & conflict, "6_create")
        .when(similar & contained, "4_skip_contained")
        .when(similar, "5_merge")
        .otherwise("6_create")
    )


def decide(found: DataFrame, incoming: DataFrame, merge: float = MERGE, store: DataFrame | None = None) -> DataFrame:
    """(id, decision, target): the lowest band over each record's candidates, then the most similar one. found is what
    candidates() gives or, if the store(id, text) is given too, nearest(): then exact copies are known by the
    hashes of their normal texts, and texts are read only for pairs that are near enough for another band."""
    new, old = tx.normalised(F.col("new_text")), tx.normalised(F.col("old_text"))
    b = band(new == old, F.col("similarity"), F.col("age_hours"), supersedes(F.col("old_text"), F.col("new_text")), F.contains(old, new), anchors_conflict(F.col("old_text"), F.col("new_text")), merge)
    if store is None:
        judged = found.withColumn("band", b)
    else:
        hashed = lambda rows, side: rows.select(F.col("id").alias(f"{side}_id"), F.sha2(tx.normalised(F.col("text")), 256).alias(f"{side}_hash"))
        known = found.join(hashed(incoming, "new"), "new_id").join(hashed(store, "old"), "old_id")
        exact = F.coalesce((F.col("new_hash") == F.col("old_hash")) & (F.col("age_hours") <= SKIP_HOURS), F.lit(False))
        # a similarity that is no number is above every threshold
        known = written(known.select("new_id", "old_id", "age_hours", "similarity", exact.alias("exact"), (~exact & (F.col("similarity") >= min(merge, SKIP))).alias("near")))
        text = lambda rows, side: rows.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
        near = known.where("near").join(text(incoming, "new"), "new_id").join(text(store, "old"), "old_id").withColumn("band", b)
        plain = known.where("not near").withColumn("band", F.when(F.col("exact"), "1_skip_exact").otherwise("6_create"))
        judged = plain.select("new_id", "old_id", "similarity", "band").unionByName(near.select("new_id", "old_id", "similarity", "band"))
    best = Window.partitionBy("new_id").orderBy("band", F.desc("similarity"), "old_id")
    first = judged.withColumn("k", F.row_number().over(best)).where("k = 1")
    out = incoming.select("id").join(first.select(F.col("new_id").alias("id"), "band", F.col("old_id").alias("target")), "id", "left")
    decision = F.coalesce("band", F.lit("6_create"))
    return out.select("id", decision.alias("decision"), F.when(decision != "6_create", F.col("target")).alias("target"))


def anchors(text: Column) -> Column:
    """Stable identifiers in a text: tracker tickets, file:line places and numbered issues, sorted."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}-\d+\b"), F.lit(0)),
        F.regexp_extract_all(text, F.lit(r"\b[\w/.-]+\.[a-z]{1,4}:\d+\b"), F.lit(0)),
        F.regexp_extract_all(text, F.lit(r"#\d+\b"), F.lit(0)),
    )
    return F.array_sort(F.array_distinct(found))


def anchors_conflict(old: Column, new: Column) -> Column:
    """Both have anchors, and not the same ones."""
    a, b = anchors(old), anchors(new)
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def occasion(text: Column) -> Column:
    """The first ISO date, quarter or year that a text names."""
    get = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.coalesce(get(r"\b\d{4}-\d{2}-\d{2}\b"), get(r"\bQ[1-4] ?\d{4}\b"), get(r"\b(?:19|20)\d{2}\b"))


def merged_text(old: Column, new: Column) -> Column:
    """The containing text, else the union of sentences by normalised form; if that is too long, the longer text."""
    parts = lambda t: F.filter(F.transform(F.split(t, r"\n+|(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    keyed = F.transform(F.concat(parts(old), parts(new)), lambda s: F.struct(tx.normalised(s).alias("k"), s.alias("s")))

    def union(rows: Column) -> Column:
        keys = F.transform(rows, lambda y: y["k"])
        return tx.let(keys, lambda ks: F.array_join(F.transform(F.filter(rows, lambda x, i: F.array_position(ks, x["k"]) == i + 1), lambda x: x["s"]), " "))

    def choose(o: Column, n: Column, joined: Column) -> Column:
        longer = F.when(F.length(new) >= F.length(old), new).otherwise(old)
        return F.when(o == n, old).when(F.contains(n, o), new).when(F.contains(o, n), old).when(F.length(joined) > MERGED_CHARS, longer).otherwise(joined)

    return tx.let(tx.normalised(old), lambda o: tx.let(tx.normalised(new), lambda n: tx.let(tx.let(keyed, union), lambda j: choose(o, n, j))))


def near_pairs(rows: DataFrame, by: str, least: float, block: int = 1000) -> DataFrame:
    """(a, b, similarity): all pairs of one tenant at a cosine of `least` (above 0) or more, for upkeep sweeps.
    Exact: a tenant's rows of one length are dealt to blocks of about `block` rows, and every two blocks meet
    in a task of their own, as one product of matrices, so no task holds a whole tenant."""
    if least <= 0:
        raise ValueError("least must be above 0")
    vector = F.col("embedding").cast("array<double>")
    scale = vec.norm(F.col("v"))
    units = rows.where(F.col(by).isNotNull() & F.col("id").isNotNull()).select(by, "id", vector.alias("v"))
    units = units.where(scale > 0).select(by, "id", F.size("v").alias("n"), tx.let(scale, lambda s: F.transform("v", lambda x: x / s)).alias("v"))
    sizes = units.groupBy(by, "n").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = units.join(sizes, [by, "n"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = dealt.select("*", other.alias("other")).select(by, "n", "id", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    met = met.repartition(by, "n", "lo", "hi")  # else the tasks are those of the join, by tenant
    found = met.groupBy(by, "n", "lo", "hi").applyInPandas(lambda pdf: _block_pairs(pdf, least), f"a {types['id']}, b {types['id']}, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _block_pairs(pdf, least: float):
    """Pairs a < b of ids between block lo and block hi of one group."""
    import numpy as np
    import pandas as pd

    left, right = (pdf[pdf["block"] == pdf[side].iloc[0]] for side in ("lo", "hi"))
    if left.empty or right.empty:
        return pd.DataFrame({"a": pdf["id"].iloc[:0], "b": pdf["id"].iloc[:0], "similarity": np.empty(0)})
    product = np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T
    i, j = np.nonzero(product >= least)
    x, y = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
    kept = x < y if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else x != y
    x, y, similarity = x[kept], y[kept], product[i, j][kept]
    return pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "similarity": similarity})
