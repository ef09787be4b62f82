"""Contradiction collapse: of a query's hits that say the same, one stays.

hits(query_id, id, rank, text, path, confidence, dated, score) is a top k: a query has few of them, so that
pairs, and the fold over them, are bounded by k squared. Pairs of one query collide if their first sentences
are equal as keys or share more than `overlap` of their words, unless they answer different questions or one
of the texts is a compound of several facts, which never gives way. Hits are then gone through by rank: each
meets the first survivor so far that it collides with, and the stronger of the two stays in that one's place.
Stronger is: with a path, of higher confidence, newer, of higher score; of equals the one that was there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import exact_qa


def first_sentence(text: Column) -> Column:
    """Up to the first CJK mark, or Latin mark before white space or the end; the whole trimmed text without one."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    found = F.regexp_extract(body, r"^[\s\S]*?(?:[。！？]|[.!?](?=\s|\z))", 0)
    return F.when(found == "", body).otherwise(found)


def statement(text: Column) -> Column:
    """Lower case, ASCII letters and digits, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def ordered(hits: DataFrame) -> DataFrame:
    """hits with place (from 0 by rank) and strength: 1 for the strongest, equal for equals. A null text is empty."""
    w = Window.partitionBy("query_id")
    strength = F.dense_rank().over(w.orderBy(F.col("path").isNull(), F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc_nulls_last("dated"), F.desc("score")))
    return hits.withColumns({"place": F.row_number().over(w.orderBy("rank", "id")) - 1, "strength": strength, "text": F.coalesce("text", F.lit(""))})


def renamed(hits: DataFrame, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """(query_id, place) of the weaker one of the strongest hits on either side of a rename, where both sides occur."""
    out = hits.where("false").select("query_id", "place")
    for old, new in renames:
        best = lambda p: F.min(F.when(F.col("text").rlike(p), F.struct("strength", "place")))
        both = hits.groupBy("query_id").agg(best(old).alias("a"), best(new).alias("b")).where("a is not null and b is not null")
        loser = F.when(F.col("a.strength") <= F.col("b.strength"), F.col("b.place")).otherwise(F.col("a.place"))
        out = out.unionByName(both.select("query_id", loser.alias("place")))
    return out.distinct()


def collisions(hits: DataFrame, overlap: float = 0.7) -> DataFrame:
    """(query_id, x, y, y_wins): places x < y of one query that say the same; y_wins, if the later one is stronger."""
    first = first_sentence(F.col("text"))
    said = hits.select("query_id", "place", "strength", "text", first.alias("first"), statement(first).alias("key"))
    said = said.withColumn("words", F.array_distinct(F.filter(F.split("key", " "), lambda w: w != "")))
    side = lambda name: said.select("query_id", *[F.col(c).alias(f"{c}_{name}") for c in ("place", "strength", "text", "first", "key", "words")])
    pairs = side("x").join(side("y"), "query_id").where("place_x < place_y")
    same = (F.col("key_x") == F.col("key_y")) | (tx.jaccard(F.col("words_x"), F.col("words_y"), 1.0) > overlap)
    alike = pairs.where(same).where(~exact_qa.answer_distinct(F.col("first_x"), F.col("first_y")))
    alike = alike.where(exact_qa.is_compact(F.col("text_x")) & exact_qa.is_compact(F.col("text_y")))
    return alike.select("query_id", F.col("place_x").alias("x"), F.col("place_y").alias("y"), (F.col("strength_y") < F.col("strength_x")).alias("y_wins"))


def survivors(places: Column, meetings: Column) -> Column:
    """The places that stay: a fold over places in order. meetings holds structs (x, y, y_wins), either way round."""

    def step(state: Column, place: Column) -> Column:
        def against(one: Column) -> Column:
            return F.get(F.filter(meetings, lambda m: ((m["x"] == one) & (m["y"] == place)) | ((m["x"] == place) & (m["y"] == one))), F.lit(0))

        def settled(met: Column) -> Column:
            """Whether `place` takes the place of the survivor that it met."""
            return F.when(met["y"] == place, met["y_wins"]).otherwise(~met["y_wins"])

        hit = F.get(F.filter(state, lambda one: against(one).isNotNull()), F.lit(0))
        replaced = lambda one: F.transform(state, lambda s: F.when(s == one, F.when(settled(against(one)), place).otherwise(one)).otherwise(s))
        return tx.let(hit, lambda one: F.when(one.isNull(), F.concat(state, F.array(place))).otherwise(replaced(one)))

    return F.aggregate(places, F.array().cast("array<int>"), step)


def collapse(hits: DataFrame, renames: Sequence[tuple[str, str]] = (), overlap: float = 0.7) -> DataFrame:
    """The hits that stay, as they came."""
    known = ordered(hits)
    if renames:
        known = known.join(renamed(known, renames), ["query_id", "place"], "left_anti")
    met = collisions(known, overlap).groupBy("query_id").agg(F.collect_list(F.struct("x", "y", "y_wins")).alias("meetings"))
    places = known.groupBy("query_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    stay = places.join(met, "query_id", "left").select("query_id", F.explode(F.when(F.col("meetings").isNull(), F.col("places")).otherwise(survivors(F.col("places"), F.col("meetings")))).alias("place"))
    kept = known.select("query_id", "id", "place").join(stay, ["query_id", "place"], "left_semi").select("query_id", "id")
    return hits.join(kept, ["query_id", "id"], "left_semi")
