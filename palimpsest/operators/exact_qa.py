"""Exact questions: their tokens, how exactly a text answers one, and whether two claims answer different ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import predicates as pr

# Words that exact comparison leaves out, where a claim's subject ends (the first that occurs in
# this order), a line of a list, and the bounds of a claim that can be compared.
STOPWORDS = (
    "a an and are as at be but by do does for from how i if in into is it its me my of on or our should that the their "
    "them there these they this those to up us was we what when where which who why will with you your"
).split()
PREDICATES = (" switched to ", " changed to ", " updated to ", " replaced ", " uses ", " use ", " is ", " are ", " was ", " were ", " = ", ":")
LIST_LINE = r"(?m)^\s*(?:[-*+]|\d+[.)])\s+\S"
LEAST_SUBJECT, MOST_SENTENCES, MOST_TOKENS, SAME_SUBJECT = 4, 2, 30, 0.6


def normal(text: Column) -> Column:
    """Lower case, without quote marks, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[`\"']", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more that aren't stop words; all distinct ones if none is left."""

    def kept(found: Column) -> Column:
        some = F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))
        return F.when(F.size(some) > 0, some).otherwise(found)

    return tx.let(F.array_distinct(F.regexp_extract_all(normal(text), F.lit(r"[\p{L}\p{N}_./:-]+"), F.lit(0))), kept)


def exact_score(query: Column, text: Column) -> Column:
    """The share of an exact question's tokens that a text holds, plus 0.25 if it holds a value; at most 1. 0 for other
    questions, and for a blank or null text."""

    def share(asked: Column) -> Column:
        held = lambda body: F.size(F.filter(asked, lambda t: F.contains(body, t))) / F.size(asked)
        return tx.let(normal(text), lambda body: F.least(F.lit(1.0), held(body) + F.when(pr.exact_value_signal(body), 0.25).otherwise(0.0)))

    usable = pr.exact_intent(query) & (F.size(tokens(query)) > 0) & (F.trim(text) != "")
    return F.when(F.coalesce(usable, F.lit(False)), tx.let(tokens(query), share)).otherwise(0.0)


def sentences(text: Column) -> Column:
    """How many sentences: split at line ends and at white space after a closing mark."""
    return F.size(F.filter(F.split(text, r"\n+|(?<=[.!?])\s+"), lambda s: s.rlike(r"\S")))


def is_compact(text: Column) -> Column:
    """Whether a text is short enough to be compared with another as one claim."""
    return (sentences(text) <= MOST_SENTENCES) & (F.size(tokens(text)) <= MOST_TOKENS)


def claim(text: Column) -> Column:
    """subject, predicate and value of a text: parted at the first of PREDICATES that it holds after LEAST_SUBJECT
    characters; null where there is none, or nothing on one side."""

    def parted(body: Column) -> Column:
        found = F.lit(None).cast("struct<subject: string, predicate: string, value: string>")
        for p in reversed(PREDICATES):
            at = F.locate(p, body)
            subject, value = F.trim(F.substr(body, F.lit(1), at - 1)), F.trim(F.substr(body, at + len(p)))
            fits = (at > LEAST_SUBJECT) & (subject != "") & (value != "")
            found = F.when(fits, F.struct(subject.alias("subject"), F.lit(p.strip()).alias("predicate"), value.alias("value"))).otherwise(found)
        return found

    return tx.let(normal(text), parted)


def items(text: Column) -> Column:
    """The lines of a list, without their marks."""
    return F.filter(F.transform(F.split(text, r"\n+"), lambda line: F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*+]|\d+[.)])\s+", ""), r"^\s+|\s+$", "")), lambda line: line != "")


def same_subject(a: Column, b: Column) -> Column:
    """Equal, or sharing SAME_SUBJECT of the smaller one's tokens."""
    x, y = tokens(a), tokens(b)
    share = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return (a == b) | F.when((F.size(x) > 0) & (F.size(y) > 0), share >= SAME_SUBJECT).otherwise(False)


def other_value(a: Column, b: Column) -> Column:
    """Different values, none inside the other, one of which holds a number, a code, a path or the like."""
    x, y = normal(a), normal(b)
    apart = (x != "") & (y != "") & (x != y) & ~F.contains(x, y) & ~F.contains(y, x)
    return apart & (pr.exact_value_signal(x) | pr.exact_value_signal(y))


def answer_distinct(a: Column, b: Column) -> Column:
    """Whether two texts answer different questions, so that neither replaces the other: two lists that differ, or two
    compact claims with one predicate, different subjects and different values."""
    listed = lambda t: F.when(t.rlike(LIST_LINE), items(t)).otherwise(F.array().cast("array<string>"))
    lists = tx.let(F.struct(listed(a).alias("a"), listed(b).alias("b")), lambda l: F.when((F.size(l["a"]) > 1) & (F.size(l["b"]) > 1), normal(F.array_join(l["a"], "\n")) != normal(F.array_join(l["b"], "\n"))))

    def apart(c: Column) -> Column:
        x, y = c["a"], c["b"]
        known = x.isNotNull() & y.isNotNull()
        return F.coalesce(known & ~same_subject(x["subject"], y["subject"]) & (x["predicate"] == y["predicate"]) & other_value(x["value"], y["value"]), F.lit(False))

    claims = tx.let(F.struct(claim(a).alias("a"), claim(b).alias("b")), apart)
    return F.coalesce(lists, claims & is_compact(a) & is_compact(b), F.lit(False))


def value_tokens(text: Column) -> Column:
    """All values of a text, in lower case: numbers, dates, versions, codes, paths, addresses, quoted code."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in pr.EXACT_VALUE if p != LIST_LINE]
    return F.array_distinct(F.transform(reduce(lambda a, b: F.concat(a, b), found), F.lower))
