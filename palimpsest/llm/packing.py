"""Best-fit packing of token pieces by non-negative least squares over length patterns.

Documents are tokenised once (ids, then the end id); a document longer than a sequence is cut into
full pieces, of which the first may be shorter. The histogram of piece lengths has at most
`capacity` bins whatever the corpus, and all planning happens on it, on the driver:

1. enumerate patterns of two to four lengths that fill a sequence exactly;
2. fit repeat counts to the histogram by non-negative least squares, round down, and clip to what
   the histogram still holds;
3. pack the residual histogram by best fit, largest lengths first, many equal bins at a time.

The plan is a list of intervals: of the pieces of one length, ranks lo..hi-1 go to consecutive
sequences at one offset. Ranks are dealt by Spark: a count for each (length, salt), prefix sums of
those counts, and a row number inside each (length, salt), so that no length - full pieces
may be most of the corpus - ends in one task.

Ids are those of the vocabulary's JSON file. Texts are read by the faster of two libraries, from the
same vocabulary as ranks; a text that it refuses, such as one with a run of a million spaces before
another character, is read from the JSON file itself, with the same ids. A text is tokenised whole,
whatever its length: a task holds its ids, four bytes each in the end, one text at a time.

Edge cases: a null text is read as empty and gives one piece that holds the end id alone; rows that
share a doc_id are packed one by one; an empty table gives an empty result; ties in a rank are
broken by doc_id, piece and checksum, rows equal in all of these are interchangeable.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows, materialize

PIECE = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE as ranks (the file of the fast reader), its special tokens, and its JSON file."""

    json_path: str
    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...]

    @staticmethod
    def public() -> Vocabulary:
        import public_tokenizers as p

        return Vocabulary(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, (("<|endoftext|>", 50256),))

    def encoding(self):
        import tiktoken

        with open(self.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("byte_bpe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=dict(self.special))

    def encoder(self) -> Callable[[str], list[int]]:
        """Ids of a text: by the fast reader, or by the JSON file where that one gives up."""
        fast, whole = self.encoding(), []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern's stack is full, or a lone surrogate
                if not whole:
                    from tokenizers import Tokenizer

                    whole.append(Tokenizer.from_file(self.json_path))
                return whole[0].encode(text, add_special_tokens=False).ids

        return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first of which may be shorter."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: Vocabulary | None = None) -> DataFrame:
    vocabulary = vocabulary or Vocabulary.public()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocabulary.encoder()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, PIECE)


# --- planning, on the histogram alone -------------------------------------------------------------


def patterns(histogram: dict[int, int], capacity: int, fan: int = 12) -> list[tuple[int, ...]]:
    """Few-document patterns that fill a sequence exactly: all pairs, and for each length `fan`
    evenly spread choices of a second one to complete to triples and quadruples."""
    have = sorted(n for n, c in histogram.items() if c and n < capacity)
    there = set(have)
    found: dict[tuple[int, ...], None] = {}

    def add(*lengths: int) -> None:
        if lengths[-1] in there:
            found[tuple(sorted(lengths, reverse=True))] = None

    for a in have:
        add(a, capacity - a)
        seconds = [b for b in have if b <= a and a + b < capacity]
        for b in seconds[:: max(1, len(seconds) // fan)]:
            add(a, b, capacity - a - b)
            thirds = [c for c in seconds if c <= b and a + b + c < capacity]
            for c in thirds[:: max(1, len(thirds) // 4)]:
                add(a, b, c, capacity - a - b - c)
    return list(found)


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: dict[int, int], passes: int = 60) -> np.ndarray:
    """min ||A x - target||, x >= 0, by projected coordinate descent on the sparse pattern columns."""
    size = max(target, default=0) + 1
    residual = np.zeros(size)
    for length, n in target.items():
        residual[length] = n
    residual = residual.tolist()
    sparse = [tuple(Counter(c).items()) for c in columns]
    norms = [sum(k * k for _, k in c) for c in sparse]
    x = [0.0] * len(columns)
    least = max(target.values(), default=0) * 1e-6
    for _ in range(passes):
        moved = 0.0
        for j, c in enumerate(sparse):
            gradient = 0.0
            for length, k in c:
                gradient += k * residual[length]
            step = max(-x[j], gradient / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, k in c:
                    residual[length] -= k * step
        if moved <= least:
            break
    return np.array(x)


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on counts: bins with equal content are kept as one entry with a number."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        for space in range(length, capacity):
            while left and open_bins[space]:
                content, n = open_bins[space].pop()
                # one bin takes as many of these as fit; a remainder takes what is left
                per = min(space // length, left)
                k = min(n, left // per)
                if n > k:
                    open_bins[space].append((content, n - k))
                open_bins[space - per * length].append((content + (length,) * per, k))
                left -= k * per
            if not left:
                break
        per = capacity // length
        if left >= per:
            open_bins[capacity - per * length].append(((length,) * per, left // per))
            left %= per
        if left:
            open_bins[capacity - left * length].append(((length,) * left, 1))
    return [b for bins in open_bins.values() for b in bins]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences but those of full pieces."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    chosen = []
    columns = patterns(left, capacity)
    fitted = nonnegative_least_squares(columns, left)
    for j in np.argsort(-fitted, kind="stable"):
        need = Counter(columns[j])
        repeats = min(int(fitted[j] + 0.5), *(left[length] // k for length, k in need.items()))
        if repeats > 0:
            chosen.append((columns[j], repeats))
            for length, k in need.items():
                left[length] -= k * repeats
    return chosen + best_fit({n: c for n, c in left.items() if c}, capacity)


def intervals(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (lo, first sequence, offset), by lo: ranks from lo on go to that
    sequence and those after it, at that offset."""
    used: Counter = Counter()
    out = defaultdict(list)
    sequence = 0
    full = histogram.get(capacity, 0)
    if full:
        out[capacity].append((0, 0, 0))
        sequence = full
    for lengths, repeats in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            out[length].append((used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


# --- the operator ----------------------------------------------------------------------------------


def ranked(cut_pieces: DataFrame, salts: int) -> DataFrame:
    """cut_pieces with `rank`: 0, 1, ... among the pieces of the same length."""
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(within))
    return numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("row") - 1).drop("row", "base", "salt")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, rows_per_salt: int = 200, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    What reaches the driver is the histogram, `capacity` rows at most; what is broadcast are the
    plan's intervals, whose number is bounded by the patterns and by capacity squared, not by rows."""
    cut_pieces = materialize(pieces(docs, capacity, end_id, vocabulary))
    histogram = {int(r["length"]): int(r["n"]) for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(intervals(histogram, capacity))
    salts = max(1, -(-max(histogram.values(), default=1) // rows_per_salt))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n in np.unique(length):
                here, rows = length == n, table.value[int(n)]
                k = np.searchsorted(rows[:, 0], rank[here], "right") - 1
                sequence[here] = rows[k, 1] + rank[here] - rows[k, 0]
                offset[here] = rows[k, 2]
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return map_rows(ranked(cut_pieces, salts), ["doc_id"], [*columns[1:], "rank"], place, f"{PIECE}, sequence_id long, offset long")
