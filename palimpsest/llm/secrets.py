"""Secret scans: fixed detectors plus character Markov models compared by log-likelihood ratio.

Base detectors find assignments, access keys and long hexadecimal strings. Two first-order
character models are then compared on every remaining long run of key characters: one of random
strings, one of ordinary identifiers and words. Both are trained from labelled samples of the
corpus: what the base detectors match in a hash sample of about `max_train_docs` documents is
"random", every other run there is "ordinary"; to the random side `synthetic` seeded strings of
the usual alphabets are added. A run whose ratio per character and in total is high enough, and
that overlaps no base span, becomes a span of kind markov.

Spans are in code points, end exclusive; an assignment's span is the whole match, name included.

Edge cases: a null text is read as empty and has no span; repeated rows give the same spans each;
an empty table gives an empty result; without ordinary runs to learn from, nothing is added.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hash_fraction, map_rows

# The base detectors.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")

ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.hexdigits[:16])
CODES = 128
EDGE = 0  # stands before the first character of a run


def long_words(text: str, least: int) -> bool:
    return any(len(w) >= least for w in text.split())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base detectors, in order."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if long_words(text, 24):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def bigrams(run: str) -> np.ndarray:
    codes = np.frombuffer(run.encode("latin-1"), np.uint8).astype(np.int64)
    return np.concatenate([[EDGE], codes[:-1]]) * CODES + codes


def free_runs(text: str, spans: list[tuple[int, int, int]], least: int) -> Iterator[tuple[int, int]]:
    """Runs of key characters that no span touches; both are walked once, in the order of the text."""
    ordered, at, covered = sorted((s, e) for s, _, e in spans), 0, 0  # covered: where the spans before `at` end
    for m in RUN.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".=-":  # sentence ends aren't part of a key
            b -= 1
        while at < len(ordered) and ordered[at][0] < b:
            covered = max(covered, ordered[at][1])
            at += 1
        if b - a >= least and covered <= a:
            yield a, b


def train(docs: DataFrame, max_train_docs: int = 20000, synthetic: int = 4000, smoothing: float = 0.5, seed: int = 17) -> np.ndarray | None:
    """Log-likelihood ratio (random against ordinary) of each character after each other, CODES x CODES."""
    n = docs.count()
    share = min(1.0, max_train_docs / max(n, 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = np.zeros((2, CODES * CODES), np.int64)
        for b in batches:
            for text in b["text"]:
                spans = base_spans(text)
                for s, kind, e in spans:
                    value = text[s:e] if kind else ASSIGN.match(text, s)[2]
                    np.add.at(tally[1], bigrams(value), 1)
                # all runs at once, each behind the edge code; pairs that end in it belong to no run
                runs = chr(EDGE) + chr(EDGE).join(text[s:e] for s, e in free_runs(text, spans, 6))
                codes = np.frombuffer(runs.encode("latin-1"), np.uint8).astype(np.int64)
                pairs = (codes[:-1] * CODES + codes[1:])[codes[1:] != EDGE]
                tally[0] += np.bincount(pairs, minlength=CODES * CODES)
        label, code = np.nonzero(tally)
        yield pd.DataFrame({"label": label, "code": code, "n": tally[label, code]})

    sample = docs.where(F.col("text").isNotNull() & hash_fraction(F.col("doc_id"), share, seed)).select("text")
    rows = sample.mapInPandas(count, "label long, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, CODES * CODES))
    for r in rows:
        counts[r["label"], r["code"]] = r["n"]
    if not counts[0].any():
        return None
    rng = random.Random(seed)
    for i in range(synthetic):
        alphabet = ALPHABETS[i % len(ALPHABETS)]
        np.add.at(counts[1], bigrams("".join(rng.choices(alphabet, k=32))), 1)
    p = counts.reshape(2, CODES, CODES) + smoothing
    p /= p.sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def markov_spans(text: str, spans: list[tuple[int, int, int]], ratio: np.ndarray, least: int, total: float, mean: float) -> list[tuple[int, int, int]]:
    found = []
    flat = ratio.ravel()
    for a, b in free_runs(text, spans, least):
        run = text[a:b]
        score = float(flat[bigrams(run)].sum())
        kinds = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run)
        if kinds >= 2 and score >= total and score >= mean * len(run):
            found.append((a, 3, b))
    return found


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, least: int = 20, total: float = 15.0, mean: float = 0.75, **training) -> DataFrame:
    """All spans of every row: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    ratio = train(docs, **training)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                text = text or ""
                base = base_spans(text)
                more = markov_spans(text, base, ratio, least, total, mean) if ratio is not None and long_words(text, least) else []
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], len(more), hashlib.sha256(listing(base).encode()).hexdigest(), listing(base + more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
