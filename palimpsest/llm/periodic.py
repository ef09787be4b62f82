"""Runs (maximal periodic stretches) of words, by string synchronising sets at dyadic scales.

Words become whole numbers, texts of a batch are laid end to end, each closed by a number of its own,
and everything below is array work on that sequence T:

- Scale 0: periods 1 and 2 are read off the positions where T[i] = T[i + p].
- Scale t = 1, 2, 4, ..: windows of t words are named by 64-bit hashes, each from two of half its length.
  Position i is in the synchronising set if the least name in the windows that start at i..i+t is that of
  the first or the last one; windows with a period of at most t / 3 (those inside shorter runs, which are
  known by then) take no part. The choice depends on the 2t words from i alone, so equal contexts are
  chosen alike, and every stretch that is not itself highly periodic has a chosen position in any t.
- A run of period p with 3t <= p < 6t holds two chosen positions with equal contexts at distance p, unless
  it begins inside a highly periodic region. All pairs of equal contexts at such distances propose p.
- Runs that begin in such a region of period q are proposed by two region ends at distance p or, where the
  region covers the whole period, by two touching regions of one period, at the distances that their phases
  allow.
- A proposal is extended both ways by names of halving length, then kept if long enough and not inside a
  run of a shorter period.

Runs found are compared word by word at the end; should two windows share a name by chance, it is all done
again with other names.

Scales shrink with the texts: they are sorted by length, and a scale works on those with 6t words or more.

Edge cases: a null text or one without words has no runs and an empty collapsed text; a row without an
id is read as it stands; rows that share an id are read one by one; a text is read whole, whatever its
length (a task holds about 200 bytes a word of one text or of `BLOCK` words, whichever is more); an
empty table gives an empty result; extra columns are ignored; equal runs can't occur, runs are ordered by
start, then period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows

#: Words that are laid end to end at a time.
BLOCK = 1 << 18


def mixed(a: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Names:
    """level(k)[i] names T[i .. i + 2^k), for as many i as texts of 2^k words or more cover."""

    def __init__(self, t: np.ndarray, covered, seed: int):
        self.covered = covered
        self.levels = [mixed(t.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = min(max(len(last) - half, 0), self.covered(2 * half))
            self.levels.append(mixed(last[:n] * np.uint64(3) + mixed(last[half : half + n])))
        return self.levels[k]

    def equal(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the 2^k words from a and from b (below 0 or past the end: no) are equal."""
        names = self.level(k)
        inside = (a >= 0) & (b < len(names))
        return inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)]) if len(names) else inside & False

    def forward(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """How many words from a and from b (a < b) are equal."""
        n = np.zeros(len(a), np.int64)
        for k in range(top, -1, -1):
            n += self.equal(k, a + n, b + n).astype(np.int64) << k
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """How many words before a and before b (a < b) are equal."""
        n = np.zeros(len(a), np.int64)
        for k in range(top, -1, -1):
            n += self.equal(k, a - n - (1 << k), b - n - (1 << k)).astype(np.int64) << k
        return n


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def inside_any(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the stretches [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def synchronised(names: Names, k: int, n: int, runs: np.ndarray) -> np.ndarray:
    """The chosen positions of scale 2^k among the first n words. runs: rows (start, end, period) known so far."""
    t = 1 << k
    window = names.level(k)[: max(n - t + 1, 0)]
    if len(window) <= t:
        return np.zeros(0, np.int64)
    periodic = np.zeros(len(window), bool)
    known = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 1] <= n)]
    if len(known):
        periodic = inside_any(known[:, 0], known[:, 1] - t + 1, len(window))
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(periodic, never, np.minimum(window, never - np.uint64(1)))
    least = least_of(value, t + 1)
    first, last = value[: len(least)], value[t:]
    return np.nonzero((least != never) & ((first == least) | (last == least)))[0]


def context_pairs(names: Names, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts of 2^(k+1) words, 3 * 2^k to 6 * 2^k apart."""
    t = 1 << k
    contexts = names.level(k + 1)
    chosen = chosen[chosen < len(contexts)]
    name = contexts[chosen]
    order = np.argsort(name, kind="stable")
    at, name = chosen[order], name[order]
    out_at, out_distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lag = 1
    while lag < len(at):
        distance = at[lag:] - at[:-lag]
        near = (name[lag:] == name[:-lag]) & (distance < 6 * t)
        if not near.any():
            break  # neighbours of a name are in order: farther ones are farther apart
        fit = near & (distance >= 3 * t)
        out_at.append(at[:-lag][fit])
        out_distance.append(distance[fit])
        lag += 1
    return np.concatenate(out_at), np.concatenate(out_distance)


def region_pairs(names: Names, k: int, n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) from highly periodic regions: runs of 3 * 2^k - 1 words or more whose period is at
    most a third of 2^k. Pairs of ends of one period, and touching pairs at the distances of equal phase."""
    t = 1 << k
    regions = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t - 1) & (runs[:, 1] <= n)]
    regions = regions[np.lexsort((regions[:, 1], regions[:, 2]))]
    ats, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lag = 1
    while lag < len(regions):
        a, b = regions[:-lag], regions[lag:]
        apart = b[:, 1] - a[:, 1]
        near = (a[:, 2] == b[:, 2]) & (apart < 6 * t)
        if not near.any():
            break
        fit = near & (apart >= 3 * t)
        ats.append(a[fit, 1] - 1)
        distances.append(apart[fit])
        lag += 1
    a, b = regions[:-1], regions[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (a[:, 0] < b[:, 0])
    for (a0, a1, q), (b0, b1, _) in zip(a[touch].tolist(), b[touch].tolist(), strict=True):
        place = np.arange(a0, a0 + q)  # where the first region has the q words that the second one begins with
        place = place[names.forward(place, np.full(q, b0), q.bit_length()) >= q]
        for start in place.tolist():
            least, most = 3 * t, min(6 * t - 1, a1 - a0, b1 - b0)
            p = np.arange(least + (b0 - start - least) % q, most + 1, q)
            ats.append(np.maximum(b0 - p, a0))
            distances.append(p)
    return np.concatenate(ats), np.concatenate(distances)


def merge(runs: np.ndarray, found: np.ndarray) -> np.ndarray:
    """runs with those of `found`, rows of (start, end, period), that lie in no run of a shorter period: these
    were all known before. Sorted by start."""
    if len(runs) and len(found):
        reach = np.maximum.accumulate(runs[:, 1])
        before = np.searchsorted(runs[:, 0], found[:, 0], side="right") - 1
        found = found[(before < 0) | (reach[np.maximum(before, 0)] < found[:, 1])]
    both = np.concatenate([runs, np.unique(found, axis=0)])
    return both[np.argsort(both[:, 0], kind="stable")]


def direct(t: np.ndarray, p: int, shortest: int) -> np.ndarray:
    """Maximal stretches of period p with `shortest` words or more."""
    same = np.concatenate([[False], t[:-p] == t[p:], [False]]).astype(np.int8)
    change = np.diff(same)
    start, end = np.nonzero(change == 1)[0], np.nonzero(change == -1)[0] + p
    long = end - start >= shortest
    return np.stack([start[long], end[long], np.full(int(long.sum()), p)], axis=1)


def sequence_runs(t: np.ndarray, sizes: list[int], shortest: int = 12, seed: int = 0) -> np.ndarray:
    """All runs of max(shortest, 2 periods) words or more of the texts that lie end to end in t, sorted by falling
    size, each closed by a number of its own. Rows of (start, end, period) by start, then period."""
    reach = np.cumsum(np.array(sizes, np.int64) + 1)
    falling = -np.array(sizes, np.int64)

    def covered(words: int) -> int:
        """Places of the texts with so many words or more."""
        count = int(np.searchsorted(falling, -words, side="right"))
        return int(reach[count - 1]) if count else 0

    runs = np.zeros((0, 3), np.int64)
    for p in (1, 2):
        if len(t) > p:
            runs = merge(runs, direct(t, p, 4))
    names = Names(t, covered, seed)
    top = max(sizes, default=0).bit_length()
    k = 0
    while covered(6 << k):
        n = covered(6 << k)
        pairs = [context_pairs(names, k, synchronised(names, k, n, runs)), region_pairs(names, k, n, runs)]
        at, p = (np.concatenate(both) for both in zip(*pairs, strict=True))
        start = at - names.backward(at, at + p, top)
        end = at + p + names.forward(at, at + p, top)
        fit = end - start >= np.maximum(2 * p, min(shortest, 12))
        runs = merge(runs, np.stack([start, end, p], axis=1)[fit])
        k += 1
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(shortest, 2 * runs[:, 2])]
    compared = runs[:, 1] - runs[:, 0] - runs[:, 2]
    offset = np.arange(compared.sum()) - np.repeat(np.cumsum(compared) - compared, compared)
    left = np.repeat(runs[:, 0], compared) + offset
    if not np.array_equal(t[left], t[left + np.repeat(runs[:, 2], compared)]):
        return sequence_runs(t, sizes, shortest, seed + 1)  # two windows shared a name
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def block_runs(texts: list[list[bytes]], shortest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text, given as words: its runs, rows of (start, end, period), and which words stay: those that no
    run holds after its first period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = [len(texts[i]) for i in order]
    numbers: dict[bytes, int] = {}
    parts = []
    for rank, i in enumerate(order):
        parts += [np.fromiter(map(numbers.setdefault, texts[i], range(len(numbers), len(numbers) + sizes[rank])), np.int64, sizes[rank]), [-1 - rank]]
    t = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    runs = sequence_runs(t, sizes, shortest)
    stays = ~inside_any(runs[:, 0] + runs[:, 2], runs[:, 1], len(t))
    begins = np.cumsum([0, *(n + 1 for n in sizes)])
    cuts = np.searchsorted(runs[:, 0], begins)
    found, kept = [np.zeros(0)] * len(texts), [np.zeros(0)] * len(texts)
    for rank, i in enumerate(order):
        own = runs[cuts[rank] : cuts[rank + 1]]
        found[i] = own - [begins[rank], begins[rank], 0]
        kept[i] = stays[begins[rank] : begins[rank] + sizes[rank]]
    return found, kept


def tandem_copies(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's texts: of one document in ten, by its id, the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse_runs(docs: DataFrame, shortest: int = 12, prepare=None) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period; of `shortest` words and two periods or
    more) and text: the words that no run holds after its first period, joined by one space, of every row. Words are
    runs of characters other than space and tab to carriage return. prepare(doc_id, words) may change them first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [None if i is None else int(i) for i in b["doc_id"]]
            at = 0
            while at < len(b):
                texts, words = [], 0
                while at < len(b) and (not texts or words < BLOCK):
                    split = (b["text"].iat[at] or "").encode().split()  # bytes part at these six characters alone
                    texts.append(prepare(ids[at], split) if prepare else split)
                    words += len(split)
                    at += 1
                found, kept = block_runs(texts, shortest)
                first = at - len(texts)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].to_numpy()[first:at],
                    "starts": [f[:, 0] for f in found], "lengths": [f[:, 1] - f[:, 0] for f in found], "periods": [f[:, 2] for f in found],
                    "text": [b" ".join(w if k.all() else [x for x, y in zip(w, k.tolist(), strict=True) if y]).decode() for w, k in zip(texts, kept, strict=True)],
                })

    found = map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "starts array<long>, lengths array<long>, periods array<long>, text string")
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return found.select("doc_id", runs.alias("runs"), "text")


def digests(collapsed: DataFrame) -> DataFrame:
    """The longest run (ties: least start, then period; nulls without runs), the number of runs, and checksums of
    all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    read = collapsed.select("doc_id", "runs", "text", best.alias("best"))
    return read.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
