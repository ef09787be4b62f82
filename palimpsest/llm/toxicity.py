"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one automaton that reads a clause: insults (runs of words
that a lexicon, learned from labels, gives a weight), threats, negation, reported speech and targets.
Their function words - targets, negations, verbs of saying and of harm - are fixed lists; a word's
symbol is looked up, everything else is in the transducers' states. What is scored is the matched
clause: a negated or reported insult counts for less than one that is aimed at somebody, and an
insult that follows another one at once for half. A logistic curve, fitted on the same labelled sample, maps a document's
clause scores to a probability.

Learning reads a sample of labelled rows of at most about `max_per_class` per label (drawn by
hash of the id, so that it is the same in every run); scoring reads every whole text.

Edge cases: a null or empty text has no clause and gets the score of a text without matches;
rows with a null id are scored but never learned from; an empty table gives an empty result;
repeated rows are scored alike; without any labelled row of either class the lexicon is empty
and every score is the smoothed share of toxic labels, UNMATCHED at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACES, fold, hash_fraction, held_out, let, map_rows, materialize, narrow

# Function words of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your you're yourself he she they him her them du dich dir ihr euch sie tu toi vous te vos usted tú ti vosotros ustedes".split())
NEGATIONS = frozenset("not never no isn't aren't don't wasn't nicht nie kein keine keinen ne pas jamais aucun nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says told claims claimed wrote quoted called alleged reported sagte schrieb behauptet dit disait écrit dijo dice escribió afirma".split())
THREATS = frozenset("kill hurt stab shoot punch destroy töten umbringen verletzen tuer frapper blesser matar golpear herir".split())

#: The highest score of a text without a matched clause.
UNMATCHED = 0.2

CLAUSE = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

# Symbols that the lexical step gives to words; the last three are made by composition.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, QUOTED = range(8)
MATCHED = (INSULT, THREAT, DENIED, QUOTED)


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer: step[state][symbol] = (next state, output symbol, weight)."""

    step: tuple[tuple[tuple[int, int, float], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads; weights multiply."""
        n = len(other.step)
        rows = []
        for a in self.step:
            for b in range(n):
                row = []
                for to, out, weight in a:
                    to2, out2, weight2 = other.step[b][out]
                    row.append((to * n + to2, out2, weight * weight2))
                rows.append(tuple(row))
        return Transducer(tuple(rows))


def _identity_row(state: int) -> list[tuple[int, int, float]]:
    return [(state, symbol, 1.0) for symbol in range(8)]


def insulting(again: float = 0.5) -> Transducer:
    """An insult; the next word, if it is one too, belongs to the same run and weighs `again`."""
    fresh, running = _identity_row(0), _identity_row(0)
    fresh[INSULT] = (1, INSULT, 1.0)
    running[INSULT] = (1, INSULT, again)
    return Transducer((tuple(fresh), tuple(running)))


def negation(span: int = 3, weight: float = 0.3) -> Transducer:
    """For `span` words after a negation, insults and threats are denied."""
    rows = []
    for left in range(span + 1):
        row = _identity_row(max(left - 1, 0))
        row[NEGATION] = (span, OTHER, 1.0)
        if left:
            row[INSULT] = row[THREAT] = (left - 1, DENIED, weight)
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def threatening(reach: int = 3) -> Transducer:
    """A threat counts where its target follows within reach; by itself it is a word like any other."""
    rows = []
    for left in range(reach + 1):
        row = _identity_row(max(left - 1, 0))
        row[THREAT] = (reach, OTHER, 1.0)
        if left:
            row[TARGET] = (0, THREAT, 1.0)
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def reported(weight: float = 0.5) -> Transducer:
    """After a verb of saying, what the rest of the clause says is quoted."""
    plain, quoting = _identity_row(0), _identity_row(1)
    plain[REPORT] = quoting[REPORT] = (1, OTHER, 1.0)
    quoting[INSULT] = quoting[THREAT] = (1, QUOTED, weight)
    return Transducer((tuple(plain), tuple(quoting)))


def targeted(bonus: float = 1.5) -> Transducer:
    """Matches after a target count for more; a threat has its own."""
    free, aimed = _identity_row(0), _identity_row(1)
    free[TARGET] = aimed[TARGET] = (1, OTHER, 1.0)
    free[THREAT] = aimed[THREAT] = (1, THREAT, 1.0)
    for symbol in (INSULT, DENIED, QUOTED):
        aimed[symbol] = (1, symbol, bonus)
    return Transducer((tuple(free), tuple(aimed)))


GRAMMAR = insulting().then(threatening()).then(negation()).then(reported()).then(targeted())
#: What a threat weighs, in units of a learned word's log odds.
THREAT_VALUE = 3.0


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...]

    def needles(self) -> list[str]:
        return sorted({*self.words, *self.stems, *THREATS})

    def lookup(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in (4, 5, 6):
            if len(word) >= n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        if word in THREATS:
            return THREAT, 0.0
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        return OTHER, 0.0

    def clause(self, words: list[str]) -> float:
        """The weight of the path that the composed automaton takes through a clause."""
        state, total = 0, 0.0
        for word in words:
            symbol, value = self.lookup(word)
            state, out, weight = GRAMMAR.step[state][symbol]
            if out in MATCHED:
                total += weight * (value if symbol == INSULT else THREAT_VALUE)
        return total

    def matches(self, text: str, needles: list[str]) -> list[tuple[int, float]]:
        """(start of the clause, its weight) of every clause with a match."""
        low = text.lower()
        if not any(x in low for x in needles):
            return []
        found, start = [], 0
        for m in [*CLAUSE.finditer(low), None]:
            end = m.start() if m else len(low)
            weight = self.clause(WORD.findall(low, start, end))
            if weight > 0:
                found.append((start, weight))
            start = m.end() if m else end
        return found

    def features(self, found: list[tuple[int, float]]) -> tuple[float, float]:
        """Of a document's matched clauses: the logarithm of their summed weights, and whether there are any."""
        return (float(np.log1p(sum(w for _, w in found))), float(bool(found)))

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Without a matched clause a document stays below UNMATCHED, however many labels are toxic."""
        b = np.asarray(self.curve)
        p = 1 / (1 + np.exp(-np.clip(b[0] + features @ b[1:], -30, 30)))
        return np.where(features[:, 1] > 0, p, np.minimum(p, UNMATCHED))


def _sample(docs: DataFrame, labels: DataFrame, max_per_class: int, seed: int) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, about max_per_class of each label at most."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("toxic") == label) & hash_fraction(F.col("doc_id"), min(1.0, max_per_class / n), seed))
    chosen = known.where(keep)
    # `chosen` holds ids of a hash sample, about 2 x max_per_class rows
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(narrow(chosen, 4 * max_per_class), "doc_id")
    # copies and near copies of one text would make its rare words look like a pattern: one row of
    # those with the same smallest hash of three words stays
    smallest = let(F.split("text", SPACES), lambda ws: F.array_min(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))))
    return rows.withColumn("like", smallest).groupBy("like", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic")


def _stem(words: Column, n: int) -> Column:
    """The first n letters, marked by *, of every longer word."""
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int = 5000, max_lexicon: int = 200, min_g2: float = 15.0, seed: int = 11) -> Model:
    """Lexicon and curve from the labelled sample. What reaches the driver: at most 4,000 lexicon
    candidates and three numbers for each sampled row."""
    sample = materialize(_sample(docs, labels, max_per_class, seed))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    stems = [_stem(words, n) for n in (4, 5, 6)]
    seen = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("feature"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    base = (pos + 0.5) / (pos + neg + 1)
    chosen_words: dict[str, float] = {}
    chosen_stems: dict[str, float] = {}
    if pos and neg:
        counted = seen.groupBy("feature").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 3")
        t, n = F.col("t"), F.col("n")
        g2 = 2 * (t * F.log(t / (n * base)) + F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - base)))).otherwise(0.0))
        odds = F.log((t + 0.5) / (pos + 1)) - F.log((n - t + 0.5) / (neg + 1))
        ranked = counted.select("feature", g2.alias("g2"), odds.alias("odds")).where((F.col("g2") >= min_g2) & (F.col("odds") >= 3.0))
        for r in ranked.orderBy(F.desc("g2"), F.length("feature").desc(), "feature").limit(4000).collect():
            name, stem = r["feature"].rstrip("*"), r["feature"].endswith("*")
            if any(name[:k] in chosen_stems for k in (4, 5, 6)) or any(x.startswith(name) for x in chosen_stems):
                continue
            if stem and sum(x.startswith(name) for x in chosen_words):
                continue
            (chosen_stems if stem else chosen_words)[name] = float(min(r["odds"], 6.0))
            if len(chosen_words) + len(chosen_stems) >= max_lexicon:
                break
    blank = Model(chosen_words, chosen_stems, (0.0, 0.0, 0.0))

    def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needles = blank.needles()
        for b in batches:
            x = [blank.features(blank.matches(s, needles)) for s in b["text"]]
            yield pd.DataFrame(x, columns=["a", "b"]).assign(y=b["toxic"].to_numpy())

    rows = sample.mapInPandas(feature_rows, "a double, b double, y int").groupBy("a", "b", "y").count().toPandas()
    return Model(chosen_words, chosen_stems, _logistic(rows, base))


def _logistic(rows: pd.DataFrame, base: float, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method on weighted feature rows."""
    beta = np.array([np.log(base / (1 - base)), 0.0, 0.0])
    if rows.empty or rows["y"].nunique() < 2:
        return tuple(beta)
    rows = rows.sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(rows)), rows[["a", "b"]].to_numpy(float)])
    y, w = rows["y"].to_numpy(float), rows["count"].to_numpy(float)
    penalty = np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty @ beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses, top_clause_start): one row per row of docs; clauses with a match and
    the code point (of the lower-cased text) where the heaviest one starts, -1 if there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needles = model.needles()
        for b in batches:
            found = [model.matches(s, needles) if s else [] for s in b["text"]]
            x = np.array([model.features(f) for f in found]).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.probability(x), "clauses": [len(f) for f in found], "top_clause_start": [max(f, key=lambda v: (v[1], -v[0]))[0] if f else -1 for f in found]})

    return map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "score double, clauses int, top_clause_start int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """Score every row of docs with a model learned from labels; predicted is 1 from `threshold` on."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses", "top_clause_start")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """Rows of docs, all columns as they came, without those whose score reaches the threshold."""
    model = learn(docs, labels, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = model.needles()
        for b in batches:
            x = np.array([model.features(model.matches(s or "", needles)) for s in b.column("text").to_pylist()]).reshape(-1, 2)
            yield b.filter(pa.array(model.probability(x) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
