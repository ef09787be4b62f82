"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language come from a hash sample of about
`max_train_per_lang` labelled documents of each language, outside the held-out fold; the matrix of log
probabilities (64 KB a language, whatever the corpus) is broadcast, and whole texts are scored in numpy, batches of texts at a time, by gathering that matrix at the texts'
n-gram buckets. A very long text is read in windows, in which every n-gram counts once.

Edge cases: a null text, or one without any letter (a character of Unicode category L: numerals such as
`²`, `½` or `Ⅷ` are none), is `und` with score 0; a null doc_id is never
learned from; an empty table, or one without labelled rows, predicts `und` throughout; ties go to
the first language by name; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fold, hash_fraction, held_out, map_rows, narrow

ORDERS = 3
#: Languages whose counts a task holds at a time while it learns.
LANGS_HELD = 200
#: Characters that are hashed and scored at a time: bounds a task's memory whatever a text's length.
CHUNK = 1 << 19


def buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each position from order - 1 on."""
    h = np.full(len(codes) - order + 1, order, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) ^ codes[k : len(codes) - order + 1 + k]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - bits)


def prepared(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)


def pieces(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Windows that overlap by two characters, so that no n-gram is lost, and how many characters of each were
    in the one before: n-grams that end among those are counted there."""
    for at in range(0, max(len(codes) - ORDERS + 1, 1), CHUNK):
        yield codes[at : at + CHUNK + ORDERS - 1], (ORDERS - 1 if at else 0)


def learn(docs: DataFrame, max_train_per_lang: int = 4000, bits: int = 14, smoothing: float = 0.1, seed: int = 23) -> tuple[list[str], np.ndarray]:
    """Language names, sorted, and their float32 log-probability matrix. The driver gets one row of 2^bits numbers
    for each language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").alias("of"))
    sizes = known.groupBy("of").agg(F.least(F.lit(1.0), max_train_per_lang / F.count("*")).alias("share"))
    # sizes is joined by broadcasting up to 100,000 languages: else a language's texts would meet in one task
    sample = known.join(narrow(sizes, 100_000), "of").where(hash_fraction(F.col("doc_id"), F.col("share"), seed))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[str, np.ndarray] = {}

        def sums() -> pd.DataFrame:
            rows = [(lang, b, n[b]) for lang, n in tally.items() for b in np.nonzero(n)[0]]
            return pd.DataFrame(rows, columns=["of", "bucket", "n"])

        for b in batches:
            for text, lang in zip(b["text"], b["of"], strict=True):
                own = tally.setdefault(lang, np.zeros(1 << bits, np.int64))
                for piece, seen in pieces(prepared(text)):
                    for order in range(1, ORDERS + 1):
                        own += np.bincount(buckets(piece, order, bits)[max(seen - order + 1, 0) :], minlength=1 << bits)
                if len(tally) > LANGS_HELD:
                    yield sums()
                    tally.clear()
        if tally:
            yield sums()

    def logs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = np.full(1 << bits, smoothing)
        p[rows["bucket"]] += rows["n"]
        return pd.DataFrame({"of": [key[0]], "row": [np.log(p / p.sum()).astype("<f4").tobytes()]})

    counts = sample.select("text", "of").mapInPandas(count, "of string, bucket int, n long").groupBy("of", "bucket").agg(F.sum("n").alias("n"))
    found = sorted((r["of"], r["row"]) for r in counts.groupBy("of").applyInPandas(logs, "of string, row binary").collect())
    matrix = np.array([np.frombuffer(row, "<f4") for _, row in found], np.float32).reshape(len(found), 1 << bits)
    return [lang for lang, _ in found], matrix


def posterior(texts: list[str], matrix: np.ndarray, bits: int) -> np.ndarray:
    """Log-probability sums (texts x languages), all texts of a chunk in one gather per order and language."""
    out = np.zeros((len(texts), len(matrix)))
    group: list[np.ndarray] = []
    owners: list[int] = []
    skips: list[int] = []

    def flush() -> None:
        codes = np.concatenate(group)
        ends = np.cumsum([len(g) for g in group])
        for order in range(1, ORDERS + 1):
            b = buckets(codes, order, bits)
            starts = np.concatenate([[0], ends[:-1]]) + np.maximum(np.array(skips) - order + 1, 0)
            last = np.minimum(ends - order + 1, len(b))  # n-grams across two texts count for neither
            for i, row in enumerate(matrix):
                total = np.concatenate([[0.0], np.cumsum(row[b], dtype=np.float64)])
                np.add.at(out[:, i], owners, total[np.maximum(last, starts)] - total[starts])
        for done in (group, owners, skips):
            done.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece, seen in pieces(prepared(text)):
            group.append(piece)
            owners.append(i)
            skips.append(seen)
            size += len(piece)
            if size >= CHUNK:
                flush()
                size = 0
    if group:
        flush()
    return out


def identify(docs: DataFrame, bits: int = 14, **training) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred under even priors) for every row."""
    langs, matrix = learn(docs, bits=bits, **training)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang = np.full(len(b), "und", object)
            score = np.zeros(len(b))
            read = [i for i, t in enumerate(b["text"]) if langs and t and any(map(str.isalpha, t))]
            if read:
                logs = posterior([b["text"].iat[i] for i in read], shared.value, bits)
                logs -= logs.max(axis=1, keepdims=True)
                best = logs.argmax(axis=1)
                score[read] = 1 / np.exp(logs).sum(axis=1)
                lang[read] = np.array(langs, object)[best]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score})

    found = map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
