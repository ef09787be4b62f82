from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"line {i} of a very long text number {i % 97} goes on" for i in range(12000))


def rows() -> list[tuple]:
    lines = "alpha one two three\nbeta four five six\ngamma seven eight nine\ndelta ten"
    base = " ".join(f"word{i}" for i in range(60))
    return [
        (1, base, "en", "s0", 1), (2, base.upper(), "en", "s0", 1), (3, base + " tail end", "de", "s1", 1), (4, None, "en", "s0", None), (5, "", None, None, 0),
        (6, "   \n\t ", "fr", "s1", 6), (7, "two words", "en", None, 9), (7, "two words", "en", None, 9), (8, lines, "en", "s0", 1), (9, "intro here\n" + lines, "en", "s1", 1),
        (None, "a row without an id\nwith lines\nand more\nwords", "en", "s0", 1), (10, LONG, "en", "s0", len(LONG)), (11, LONG, "en", "s2", len(LONG)), (12, "1234 5678 !!", "en", "s0", 12),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(7) for c in ("score", "piece", "length", "rank", "hi", "n_removed", "kept", "copies", "n_entities", "value")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (8, 0, 1), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
