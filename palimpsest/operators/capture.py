"""Capture: scoring and compressing messages, decisions, dates, keys and tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

# Cue lists, tried in the order given.
TOOL = (r"(?i)\btool_use\b", r"(?i)\btool_result\b", r"(?i)\bfunction_call\b", r"(?i)\b(memory_store|memory_recall|memory_forget|memory_update)\b")
CORRECTION = (r"(?i)^no[,.\s]", r"(?i)\bactually\b", r"(?i)\binstead\b", r"(?i)\bwrong\b", r"(?i)\bcorrect(ion)?\b", r"(?i)\bfix\b", "不对", "应该是", "應該是", "错了", "錯了", "改成", "不是.*而是")
DECISION = (
    r"(?i)\blet'?s go with\b", r"(?i)\bconfirmed?\b", r"(?i)\bapproved?\b", r"(?i)\bdecided?\b", r"(?i)\bwe'?ll use\b", r"(?i)\bgoing forward\b", r"(?i)\bfrom now on\b", r"(?i)\bagreed\b",
    "决定", "決定", "确认", "確認", "选择了", "選擇了", "就这样", "就這樣",
)
SYSTEM_XML = (r"^<[a-z-]+>", r"</[a-z-]+>\s*$")
EXACT = (r"(?i)\bexact(?:ly)?\b", r"(?i)\bcommit\b", r"\b[A-Z][A-Z0-9_]{2,}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d+(?:\.\d+){1,}\b", r"\b\d+\b", r"`[^`]+`", r"/[\w./-]+", r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S", r"```")
ACKNOWLEDGE = (r"(?i)^(ok|okay|k|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|alright|yep|yup|yeah|right)\s*[.!]?$", r"^好的?\s*[。！]?$", r"^嗯\s*[。]?$", r"^收到\s*[。！]?$", r"^了解\s*[。！]?$", r"^明白\s*[。！]?$", r"^谢谢\s*[。！]?$", r"^感谢\s*[。！]?$", r"^👍\s*$")
DECISION_MARKERS = ("we decided to", "we'll go with", "going with", "let's go with", "decided to use", "decided on", "chose to", "we chose", "settled on", "final answer is", "i'll choose", "we'll use")


def message_score(text: Column) -> Column:
    """First match wins: tool call, correction, decision, system block, exact evidence, acknowledgment, length, question."""
    t = F.trim(text)
    long = F.length(t) > F.when(t.rlike("[一-鿿぀-ヿ가-힯]"), 30).otherwise(80)
    return (
        F.when(t == "", 0.0).when(tx.any_match(t, TOOL), 1.0).when(tx.any_match(t, CORRECTION), 0.95).when(tx.any_match(t, DECISION), 0.85)
        .when(t.rlike(SYSTEM_XML[0]) & t.rlike(SYSTEM_XML[1]), 0.3).when(tx.any_match(t, EXACT), 0.82).when(tx.any_match(t, ACKNOWLEDGE), 0.1)
        .when(long, 0.7).when(F.contains(t, F.lit("?")) | F.contains(t, F.lit("？")), 0.5).otherwise(0.4)
    )


def leftmost(text: Column, markers: tuple[str, ...]) -> Column:
    """1-based place of the first marker, null without one."""
    return F.least(*[F.nullif(F.locate(m, F.lower(text)), F.lit(0)) for m in markers]).cast("long")


def with_dates(text: Column, anchor: Column) -> Column:
    """The text with the dates that its relative phrases mean, from an anchor day, in brackets at the end;
    dates that are there already aren't added again."""
    low = F.lower(text)
    n = lambda unit: F.regexp_extract(low, rf"\b(\d{{1,4}})\s+{unit}s?\s+ago\b", 1).try_cast("int")
    day, month, year = (lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_format(c, "yyyy-MM")), (lambda c: F.date_format(c, "yyyy"))
    first = F.trunc(anchor, "month")
    said = lambda phrase, value: F.when(low.rlike(rf"\b{phrase}\b"), value)
    before = low.rlike(r"\bday before yesterday\b")
    found = F.array(
        day(F.date_sub(anchor, n("day"))), day(F.date_sub(anchor, n("week") * 7)), month(F.add_months(first, -n("month"))), year(F.add_months(first, n("year") * -12)),
        F.when(before, day(F.date_sub(anchor, 2))), said("yesterday", day(F.date_sub(anchor, 1))), said("tomorrow", day(F.date_add(anchor, 1))), said("today", day(anchor)),
        said("last week", day(F.date_sub(anchor, 7))), said("next week", day(F.date_add(anchor, 7))), said("last month", month(F.add_months(first, -1))), said("next month", month(F.add_months(first, 1))),
        said("last year", year(F.add_months(first, -12))), said("next year", year(F.add_months(first, 12))),
    )
    new = F.array_distinct(F.filter(found, lambda d: d.isNotNull() & ~F.contains(text, d)))
    return F.when(F.size(new) > 0, F.concat(text, F.lit(" ("), F.array_join(new, ", "), F.lit(")"))).otherwise(text)


def tags(values: Column) -> Column:
    """Lower case, trimmed, not empty, ten at most."""
    return F.slice(F.filter(F.transform(values, lambda v: F.trim(F.lower(v))), lambda v: v != ""), 1, 10)


def djb2(text: Column) -> Column:
    """The 32-bit djb2 hash of a text's UTF-16 units, as an unsigned number in a long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        power = np.ones(1, np.uint32)  # of 33, wrapped as the hash is

        def one(text: str | None) -> int | None:
            nonlocal power
            if text is None:
                return None
            units = np.frombuffer(text.encode("utf-16-be", "surrogatepass"), ">u2").astype(np.uint32)
            while len(power) <= len(units):
                power = np.concatenate([power, power * np.uint32(pow(33, len(power), 1 << 32))])
            n = len(units)
            return (5381 * int(power[n]) + int((units * power[:n][::-1]).sum(dtype=np.uint32))) % (1 << 32)

        return pd.Series([one(t) for t in texts], dtype="Int64")

    return hashed(text)


def fact_key(category: Column, text: Column) -> Column:
    """category:slug-hash. The hash is of the text as it is; the slug has the first six words, between spaces and
    punctuation, that are letters a-z and digits only; with fewer than two of them the hash stands alone."""
    words = F.transform(F.split(text, r"[\s\p{Z}\x{FEFF}\p{P}]+"), lambda w: F.lower(w))
    slug = F.slice(F.filter(words, lambda w: w.rlike("^[a-z0-9]+$")), 1, 6)
    code = F.right(F.lpad(F.lower(F.hex(djb2(text))), 8, "0"), F.lit(6))
    start = tx.let(slug, lambda s: F.when(F.size(s) >= 2, F.concat(F.array_join(s, "-"), F.lit("-"))).otherwise(""))
    return F.concat(category, F.lit(":"), start, code)


def compress(turns: DataFrame, by: str, most: int) -> DataFrame:
    """Turns of each conversation within `most` characters: the first and the last, then by score while they
    fit; in their order. A conversation is one group; its turns are few."""
    scored = turns.select(by, "turn", "role", "text", message_score(F.col("text")).alias("score"), F.length("text").alias("n"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "role", "text"]).reset_index(drop=True)
        order = [0, len(rows) - 1, *rows.sort_values(["score", "turn"], ascending=[False, True]).index]
        kept, used = [], 0
        for i in dict.fromkeys(order):
            if used + rows["n"][i] <= most or not kept:
                kept.append(i)
                used += rows["n"][i]
        return rows.loc[sorted(kept), [by, "turn", "role", "score"]]

    return scored.groupBy(by).applyInPandas(pick, f"{by} long, turn long, role string, score double")
