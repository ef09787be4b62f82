"""Text functions of retrieval and write arbitration."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Words that a keyword query leaves out.
STOPWORDS = frozenset(
    "a an and are as at be but by do for from how i if in into is it its let me my of on or our should that the their them there "
    "these they this those to up us was we what when where which who why will with you your".split()
)

# Where a statement's subject ends; the leftmost one counts.
DELIMITERS = (
    ":", " is ", " are ", " was ", " were ", " = ", " uses ", " use ", " switched to ", " changed to ", " updated to ",
    " moved to ", " moved from ", " relocated to ", " resides in ", " lives in ", " renamed to ",
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def significant_tokens(query: str) -> list[str]:
    """A query's distinct tokens of three letters or more that aren't stop words; all of them if none is left."""
    found = list(dict.fromkeys(re.findall(r"[^\W]+", query.lower())))
    kept = [t for t in found if len(t) > 2 and t not in STOPWORDS]
    return kept or found


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f]+", " "))


def _leftmost(text: Column, least: int) -> Column:
    """1-based place of the leftmost delimiter from `least` (0-based) on; null if there is none."""
    places = [F.nullif(F.locate(d, text, least + 1), F.lit(0)) for d in DELIMITERS]
    return F.least(*places)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: bound as a lambda variable, it is never expanded in place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statement_key(text: Column) -> Column:
    """What comes before the leftmost delimiter, or the first eight words."""

    def key(norm: Column) -> Column:
        words = F.array_join(F.slice(F.split(norm, " "), 1, 8), " ")
        return let(_leftmost(norm, 8), lambda at: F.when(at.isNotNull(), F.trim(F.substr(norm, F.lit(1), at - 1))).otherwise(words))

    return let(normalised(text), key)


def statement_value(text: Column) -> Column:
    """What comes after the leftmost delimiter, or the whole text."""

    def after(rest: Column) -> Column:
        return F.trim(reduce(lambda c, d: F.when(rest.startswith(d), F.substr(rest, F.lit(len(d) + 1))).otherwise(c), reversed(DELIMITERS), rest))

    def value(norm: Column) -> Column:
        return let(_leftmost(norm, 0), lambda at: F.when(at.isNotNull(), let(F.substr(norm, at), after)).otherwise(norm))

    return let(normalised(text), value)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark, Latin or CJK; the whole text without one."""
    found = F.regexp_extract(text, r"^[\s\S]*?[.!?。！？]", 0)
    return F.when(found == "", text).otherwise(found)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def sanitised(text: Column) -> Column:
    """One line that is safe to quote: no NULs, terminal escapes, line breaks or leading quote marks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\x1B\[[0-9;]*[A-Za-z]", ""), r"\x00", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\r\n]+", " "), r"^(?:> ?)+", "")


def any_match(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def count_matches(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """|a & b| / |a | b| of two arrays; `empty` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)
