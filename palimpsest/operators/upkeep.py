"""Upkeep: the consolidation sweep, near orphans that share an entity, and what captures say of recalled records.

The sweep is incremental: rows written after a tenant and scope's watermark meet all rows of theirs, rows that
were swept before never meet each other again. A row is superseded by the earliest newer one that is near and
holds all its values. That rule depends on no order of work, so that two sweeps give what one gives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import exact_qa
from palimpsest.operators import lifecycle as lc
from palimpsest.operators.arbitration import near_pairs
from palimpsest.operators.stored import small, written

# The cosine from which a row may replace an older one, and from which orphans belong together.
SAME, TOGETHER = 0.90, 0.82
GROUP = ["user_id", "scope"]


def near_new(new: DataFrame, rows: DataFrame, least: float = SAME, block: int = 2000) -> DataFrame:
    """(new_id, other_id, similarity): rows of one user and scope, one side of them new, at a cosine of `least` or
    more; exact. new and rows hold id, user_id, scope and embedding; each group's rows are dealt to blocks, and
    every block of new ones meets every block of all in a task of its own. Rows without user, scope or a
    direction meet nobody."""

    def dealt(df: DataFrame, own: str, other: str, opposite: DataFrame) -> DataFrame:
        n = lambda d: d.groupBy(*GROUP).agg(F.ceil(F.count("*") / block).alias("n"))
        usable = df.where("user_id is not null and scope is not null and size(embedding) > 0")
        mine, theirs = n(usable).withColumnRenamed("n", "mine"), n(opposite).withColumnRenamed("n", "theirs")
        placed = usable.join(mine, GROUP).join(theirs, GROUP)
        return placed.select(*[F.col(c).alias(f"{own}_{c}") for c in (*GROUP, "id")], F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.col("mine")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("theirs") - 1)).alias(other)).toDF(*[f"{own}_{c}" for c in GROUP], "id", "v", own, other)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        sizes = right["v"].map(len).to_numpy()
        for size, part in left.groupby(left["v"].map(len)):
            same = right[sizes == size]
            if len(same):
                a, b = (np.array(x["v"].tolist(), np.float64) for x in (part, same))
                a, b = (np.divide(m, s, out=np.zeros_like(m), where=s > 0) for m, s in ((m, np.sqrt((m * m).sum(axis=1, keepdims=True))) for m in (a, b)))
                product = a @ b.T
                i, j = np.nonzero(product >= least)
                out.append((part["id"].to_numpy()[i], same["id"].to_numpy()[j], product[i, j]))
        x, y, s = (np.concatenate(parts) for parts in zip(*out, strict=True))
        apart = x != y
        return pd.DataFrame({"new_id": x[apart], "other_id": y[apart], "similarity": s[apart]})

    left, right = dealt(new, "i", "j", rows), dealt(rows, "j", "i", new)
    cells = [df.groupBy(f"{own}_user_id", f"{own}_scope", "i", "j") for df, own in ((left, "i"), (right, "j"))]
    return cells[0].cogroup(cells[1]).applyInPandas(meet, "new_id long, other_id long, similarity double")


def due(rows: DataFrame, watermarks: DataFrame | None, most: int | None) -> DataFrame:
    """rows with swept: whether this sweep takes them. Those written after their group's watermark are due, of these
    the `most` first by time; but a moment is swept whole or not at all, since the watermark can't part it."""
    if watermarks is not None:
        rows = rows.join(watermarks.select(*GROUP, "watermark"), GROUP, "left")
    else:
        rows = rows.withColumn("watermark", F.lit(None).cast("timestamp"))
    late = F.col("watermark").isNull() | (F.col("written_at") > F.col("watermark"))
    if most is None:
        return rows.withColumn("swept", late).drop("watermark")
    w = Window.partitionBy(*GROUP).orderBy("written_at")
    counted = rows.where(late).groupBy(*GROUP, "written_at").agg(F.count("*").alias("n"))  # moments, not rows
    taken = counted.withColumn("taken", (F.sum("n").over(w) <= most) | (F.row_number().over(w) == 1)).where("taken").select(*GROUP, "written_at", "taken")
    return rows.join(taken, [*GROUP, "written_at"], "left").withColumn("swept", F.coalesce("taken", F.lit(False))).drop("taken", "watermark")


def sweep(rows: DataFrame, watermarks: DataFrame | None = None, most: int | None = None, least: float = SAME) -> tuple[DataFrame, DataFrame]:
    """Superseded rows (id, superseded_by, similarity) and the new watermarks (user_id, scope, watermark) of one sweep
    over active rows(id, user_id, scope, text, embedding, created_at, written_at)."""
    judged = written(due(rows, watermarks, most))
    # rows that are due but not swept yet are not looked at by those that are
    seen = judged.join(watermarks.select(*GROUP, "watermark"), GROUP, "left") if watermarks is not None else judged.withColumn("watermark", F.lit(None).cast("timestamp"))
    seen = seen.where(F.col("swept") | (F.col("written_at") <= F.col("watermark")))
    met = near_new(judged.where("swept"), seen, least)
    at = judged.select("id", F.struct("created_at", "id").alias("at"), exact_qa.value_tokens(F.col("text")).alias("values"))
    side = lambda name: at.select(F.col("id").alias(f"{name}_id"), F.col("at").alias(f"{name}_at"), F.col("values").alias(f"{name}_values"))
    both = met.join(side("new"), "new_id").join(side("other"), "other_id")
    newer = F.col("new_at") > F.col("other_at")
    pick = lambda a, b: F.when(newer, F.col(a)).otherwise(F.col(b))
    pairs = both.select(pick("other_id", "new_id").alias("id"), pick("new_at", "other_at").alias("by"), pick("other_values", "new_values").alias("old"), pick("new_values", "other_values").alias("kept"), "similarity")
    held = pairs.where(F.size(F.array_except("old", "kept")) == 0)
    found = held.groupBy("id").agg(F.min(F.struct("by", "similarity")).alias("first")).select("id", F.col("first.by.id").alias("superseded_by"), F.col("first.similarity").alias("similarity"))
    through = judged.where("swept").groupBy(*GROUP).agg(F.max("written_at").alias("watermark"))
    if watermarks is not None:
        through = through.unionByName(watermarks.select(*GROUP, "watermark")).groupBy(*GROUP).agg(F.max("watermark").alias("watermark"))
    return found, through


def near_orphans(orphans: DataFrame, edges: DataFrame, least: float = TOGETHER) -> DataFrame:
    """(a, b, similarity, shared): orphans(id, user_id, embedding) of one user at a cosine of `least` or more that share
    an entity of edges(entity, id). Near pairs are few, so only these look for entities, and of the edges only
    those of their ids are told apart and joined."""
    near = written(near_pairs(orphans, "user_id", least))
    ids = small(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    known = written(edges.select("entity", "id").join(ids, "id", "left_semi").distinct())
    mine = near.join(known.withColumnRenamed("id", "a"), "a")
    return mine.join(known.withColumnRenamed("id", "b"), ["b", "entity"]).groupBy("a", "b", "similarity").agg(F.count("*").alias("shared"))


def latest_trace(captures: DataFrame, traces: DataFrame, by: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """captures with trace: the latest of traces(trace_id, at, ..) of the same `by` at or before the capture's at, all its
    columns as a struct; null if there is none. No inequality join: both are laid on one line of time. A window
    runs inside buckets of time, and one over a row for each bucket carries the last trace on, so that a session
    with a third of all rows is many tasks."""
    whole = F.struct("at", "trace_id", *[c for c in traces.columns if c not in ("at", "trace_id", *by)])
    bucket = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / bucket_seconds)
    left = traces.select(*by, "at", bucket.alias("bucket"), F.lit(0).alias("kind"), F.col("trace_id").alias("order"), whole.alias("trace"), F.lit(None).cast(captures.select(F.struct("*")).schema[0].dataType).alias("capture"))
    right = captures.select(*by, "at", bucket.alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast(traces.schema["trace_id"].dataType).alias("order"), F.lit(None).cast(left.schema["trace"].dataType).alias("trace"), F.struct(*captures.columns).alias("capture"))
    inside = Window.partitionBy(*by, "bucket").orderBy("at", "kind", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = left.unionByName(right).withColumn("own", F.last("trace", ignorenulls=True).over(inside)).where("kind = 1")
    ends = left.groupBy(*by, "bucket").agg(F.max("trace").alias("end"))
    # one row a bucket, of traces or of captures
    marks = ends.unionByName(right.select(*by, "bucket").distinct().withColumn("end", F.lit(None).cast(left.schema["trace"].dataType))).groupBy(*by, "bucket").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select(*by, "bucket", "carried")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "bucket")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return own.alias("o").join(carried.alias("c"), condition, "left").select("o.capture.*", F.coalesce("o.own", "c.carried").alias("trace"))


def accrued(captures: DataFrame, traces: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """What captures(at, answer, ..) say of the records that their session's latest trace(trace_id, at, items, status)
    recalled: the usefulness state after all of them, of every record(id, text, prior) that was judged, with
    status_retrieved and status_used for traces of a status intent. A capture whose last message isn't an answer
    (null or blank) says nothing; an item that isn't a record is left out."""
    told = latest_trace(captures.where(F.trim("answer") != ""), traces, by).where("trace is not null")
    items = told.select("answer", F.col("trace.status").alias("status"), F.explode(F.array_distinct("trace.items")).alias("id"))
    no = F.lit(False)
    judged = items.join(records.select("id", "text", "prior"), "id").withColumn("evidence", lc.evidence(F.col("text"), F.col("answer"), F.lit("none"), no, no))
    judged = written(judged.select("id", "prior", "evidence", "status", no.alias("corrected"), no.alias("cross_session")))
    status = judged.groupBy("id").agg(F.count_if("status").alias("status_retrieved"), F.count_if(F.col("status") & (F.col("evidence") >= 0.35)).alias("status_used"))
    return lc.usefulness(judged, ["id"]).join(status, "id")
